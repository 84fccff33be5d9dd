"""Verbena: a PySpark-native engine for species-distribution and answer-quality studies."""

__version__ = "0.1.0"
