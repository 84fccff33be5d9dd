"""Problem 8: the documents cut into sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .sentences import sentences


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per number of characters, in steps of 20."""
    n = F.floor((F.col("end_char") - F.col("start_char")) / 20) * 20
    return p8_found(spark, sf_dir).groupBy(n.cast("int").alias("from_chars")).agg(F.count("*").alias("n_units"))


QUERIES = {"p8_found": p8_found, "p8_lengths": p8_lengths}
ORACLE: dict[str, str] = {}
