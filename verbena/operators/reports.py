"""The analyses of a report as tables: means with intervals, rank tests per stratum, metrics by tier, generators side by side, agreement of people and judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import whole
from ..runtime import checked_join, materialise
from . import aggregates as A
from . import stats as Q
from .relational import number


def tier_statistics(df: DataFrame, by: Sequence[str], value: str, n_boot: int = 10_000) -> DataFrame:
    """(by, mean, std, n, ci_low, ci_high) of the numbers of a column; groups without one are left out."""
    by = list(by)
    plain = A.describe(df, by, value).filter("n > 0")
    bounds = Q.bootstrap_ci(df, by, value, n_boot).select(*by, F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return plain.alias("p").join(bounds.alias("b"), same, "left").select(*(F.col(f"p.{c}") for c in by), "mean", "std", "n", "ci_low", "ci_high")


def stratum_report(df: DataFrame, stratum: str, tiers: Sequence[str], value: str, block: str = "especie", tier: str = "tier", n_boot: int = 10_000) -> dict[str, DataFrame]:
    """Of each stratum, and of all together (stratum "all"): tier_stats, friedman, wilcoxon."""
    rows = df.filter(F.col(stratum).isNotNull()).withColumn("stratum", F.col(stratum).cast("string")).unionByName(df.withColumn("stratum", F.lit("all")))
    rows = rows.filter(F.col(tier).isin(*tiers))
    return {
        "tier_stats": tier_statistics(rows, ["stratum", tier], value, n_boot),
        "friedman": Q.friedman(rows, block, tier, tiers, value, by=["stratum"]),
        "wilcoxon": Q.wilcoxon_pairs(rows, block, tier, tiers, value, by=["stratum"]),
    }


def metric_report(df: DataFrame, metrics: Sequence[str], tiers: Sequence[str], tier: str = "tier", n_boot: int = 10_000) -> DataFrame:
    """(metric, tier, mean, std, n, ci_low, ci_high) of the metrics the table has; what is no number does not count."""
    have = [m for m in metrics if m in df.columns]
    long = df.filter(F.col(tier).isin(*tiers)).select(tier, *(number(m).alias(m) for m in have)).unpivot([tier], have, "metric", "value").filter("value is not null")
    return tier_statistics(long, ["metric", tier], "value", n_boot)


def generator_comparison(df: DataFrame, model: str, value: str, block: str = "especie", tier: str = "tier", least: int = 5) -> DataFrame:
    """(tier, model_1, model_2, mean_1, mean_2, w, p, n): the first two models (by name) of each tier over the blocks that have both; tiers with fewer than ``least`` such blocks, or no difference, are left out."""
    rows = df.filter(F.col(model).isNotNull() & F.col(tier).isNotNull() & F.col(value).isNotNull())
    names = materialise(rows.select(tier, model).distinct(), "report-models")
    place = F.dense_rank().over(Window.partitionBy(tier).orderBy(model))  # of models, not of rows
    two = names.withColumn("__place", place).filter("__place <= 2")
    coded = checked_join(rows, two, [tier, model]).withColumn("__label", F.format_string("m%d", "__place"))
    full = Q.complete_blocks(coded, block, "__label", ["m1", "m2"], value, by=[tier])
    means = full.groupBy(tier).agg(*(F.avg(F.when(F.col("label") == f"m{i}", F.col("value"))).alias(f"mean_{i}") for i in (1, 2)))
    tested = Q.wilcoxon_pairs(coded, block, "__label", ["m1", "m2"], value, least, by=[tier]).filter("w is not null")
    named = two.groupBy(tier).agg(*(F.max(F.when(F.col("__place") == i, F.col(model))).alias(f"model_{i}") for i in (1, 2)))
    return tested.select(tier, "w", "p", "n").join(means, tier).join(named, tier).select(tier, "model_1", "model_2", "mean_1", "mean_2", "w", "p", "n")


def paired_marks(pairs: DataFrame, metrics: Sequence[str], keep: Sequence[str] = (), left: str = "h_", right: str = "l_") -> DataFrame:
    """(keep, metric, human, judge): whole marks of both sides where both have one; halves go to the even mark. pairs: one row per pair, columns with the sides' prefixes."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(left + m).cast("int").alias("human"), whole(right + m).alias("judge")) for m in metrics))
    return pairs.select(*keep, F.explode(each).alias("p")).select(*keep, "p.*").filter("human is not null and judge is not null")




def agreement_by_metric(pairs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n, kappa): linearly weighted kappa of people and judges per metric."""
    return Q.weighted_kappa(paired_marks(pairs, metrics, by), "human", "judge", [*by, "metric"])
