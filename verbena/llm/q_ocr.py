"""Problem 3: habitat and distribution notes from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .ocr import Scans

FIELDS = ("habitat_raw", "geographic_notes")


def _scans(spark: SparkSession, sf_dir: str) -> Scans:
    t = table(spark, sf_dir, "picked_species_enhanced")
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS))
    return Scans(t.select(F.col("pick_id").alias("row_id"), F.explode(pairs).alias("p")).select("row_id", "p.field_name", "p.text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).noise().withColumnRenamed("row_id", "pick_id")


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).paragraphs().withColumnRenamed("row_id", "pick_id")


def p3_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The misread words with their corrections (null: none known) and the texts that have them."""
    return _scans(spark, sf_dir).misread.groupBy("word", "right").agg(F.count("*").alias("n_texts"))


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p3_corrections": p3_corrections}
ORACLE: dict[str, str] = {}
