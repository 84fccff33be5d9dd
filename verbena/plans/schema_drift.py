"""Problem 5: schema drift of the raw record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import Drift
from ..runtime import table

NESTED = {"eval": ("judge_A_scores", "judge_B_scores")}


def _drift(spark: SparkSession, sf_dir: str) -> Drift:
    return Drift(table(spark, sf_dir, "raw_records"), NESTED)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).changes().select("file_name", "field_path", "change_kind").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).changes().groupBy("feed", "field_path", "change_kind").agg(F.count("*").alias("n_files"))


def _unified(feed: str):
    return lambda spark, sf_dir: _drift(spark, sf_dir).unified(feed)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_results": _unified("results"), "p5_eval": _unified("eval"), "p5_experiment_meta": _unified("experiment_meta")}
ORACLE: dict[str, str] = {}
