"""Problem 6: held-out questions inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table
from .leakage import leaks, without_spans


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that leaked, with the number of documents and the largest share."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("share").alias("largest_share"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the leaked passages."""
    documents = table(spark, sf_dir, "documents")
    return without_spans(documents.select("doc_id", "text", "lang", "source"), materialise(_leaks(spark, sf_dir), "leaks"))


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p6_clean": p6_clean}
ORACLE: dict[str, str] = {}
