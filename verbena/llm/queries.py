"""Queries of the subpackage, by problem."""

from __future__ import annotations

from . import q_consensus, q_leakage, q_mixing, q_names, q_ocr, q_sentences

MODULES = [q_names, q_ocr, q_consensus, q_leakage, q_mixing, q_sentences]
