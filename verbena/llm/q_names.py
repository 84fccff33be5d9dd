"""Problem 2: plant names as typed, mapped to the canonical list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .names import map_names


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = table(spark, sf_dir, "picked_species").select(F.lit("picked_species").alias("src_table"), F.col("pick_id").alias("row_id"), F.col("species").alias("name"))
    results = table(spark, sf_dir, "results").select(F.lit("results").alias("src_table"), "row_id", F.col("especie").alias("name"))
    return map_names(picked.unionByName(results), table(spark, sf_dir, "species_reference").select("ref_id", "species", "synonyms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("src_table", "row_id", "ref_id").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that mean no entry, with their rows."""
    return _mapped(spark, sf_dir).filter("ref_id = 0").groupBy("src_table", "name").agg(F.countDistinct("row_id").alias("n_rows"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
ORACLE: dict[str, str] = {}
