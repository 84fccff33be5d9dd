"""Grouped summaries. All are hash aggregates with partial sums before the shuffle; nulls are left out of means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import not_nan


def mean(c: str) -> Column:
    return F.avg(F.col(c).cast("double"))


def summary(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value and the number of rows, per group."""
    return df.groupBy(*by).agg(*(mean(v).alias(f"avg_{v}") for v in values), F.count("*").alias("n"))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation and count of the numbers (neither null nor NaN)."""
    v = not_nan(F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def conditional_means(df: DataFrame, by: str, label: str, labels: Sequence[str], value: str) -> DataFrame:
    """One row per group with the mean under each label."""
    return df.groupBy(by).agg(*(F.avg(F.when(F.col(label) == x, F.col(value).cast("double"))).alias(f"mean_{x}") for x in labels))


def pivot_mean(df: DataFrame, rows: str, label: str, labels: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(rows).pivot(label, list(labels)).agg(F.avg(F.col(value).cast("double")))


def levels(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Means per (outer, inner) and, with outer null and all_levels 1, per inner over all."""
    return df.groupingSets([[outer, inner], [inner]], outer, inner).agg(F.grouping(outer).cast("int").alias("all_levels"), F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts of the values, the most frequent k first (ties by value)."""
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    return c if k is None else c.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def first_seen(df: DataFrame, by: str, order: str, values: Sequence[str]) -> DataFrame:
    """The values of each group's first row, and its row count."""
    first = F.min_by(F.struct(*values), F.col(order))
    return df.groupBy(by).agg(first.alias("f"), F.count("*").alias("n")).select(by, "f.*", "n")


def arg_max(df: DataFrame, by: str, label: str, value: str) -> DataFrame:
    """Label of the largest value per group; of equal ones the least label."""
    best = F.min_by(F.struct(label, value), F.struct(-F.col(value), F.col(label)))
    return df.filter(F.col(value).isNotNull()).groupBy(by).agg(best.alias("b")).select(by, F.col(f"b.{label}").alias("winner"), F.col(f"b.{value}").alias("best"))


def collected_pairs(df: DataFrame, outer: str, inner: str, leaf: str) -> DataFrame:
    """(outer, inner, leaves): the sorted distinct leaves of each pair; they are few, the pairs may be many."""
    return df.filter(F.col(outer).isNotNull() & F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.sort_array(F.collect_set(leaf)).alias("leaves"))


def collected(df: DataFrame, outer: str, inner: str, leaf: str) -> DataFrame:
    """Per outer key a map from inner key to its leaves, for outer keys with few inner ones; beyond that ``collected_pairs`` has the same without a row per outer key."""
    return collected_pairs(df, outer, inner, leaf).groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "leaves")))).alias("tree"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(truth, predicted).agg(F.count("*").alias("n"))


def share_of(df: DataFrame, flag: Column, name: str = "pct") -> DataFrame:
    """Percentage of rows that have the flag."""
    return df.agg((F.count_if(flag) * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias(name), F.count("*").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null where one does not vary."""
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlation_direction(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of x and y per group and its sign; without a correlation the sign is NEGATIVE."""
    r = correlation(F.col(x), F.col(y))
    return df.groupBy(*by).agg(r.alias("r")).withColumn("direction", F.when(F.col("r") > 0, "POSITIVE").otherwise("NEGATIVE"))


def filled_with_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Nulls and NaN replaced by the group's mean; the means are joined back, so no group is gathered."""
    v = not_nan(F.col(value).cast("double"))
    means = df.groupBy(*by).agg(F.avg(v).alias("__mean"))
    return df.join(means, list(by), "left").withColumn(value, F.coalesce(v, "__mean")).drop("__mean")
