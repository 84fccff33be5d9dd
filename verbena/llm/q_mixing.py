"""Problem 7: documents combined by source to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .mixing import Mix, mix


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).shares()


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
