"""Order-dependent operators that never sort an unbounded group in one task.

Ranks over large groups come from counts per value: groups are cut at sampled quantiles, counts of the
cuts are summed, and only the inside of a cut is sorted. Equal values fall into one cut, whose rows are
first reduced to one per value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import checked_join, materialise
from .relational import not_nan

#: Distinct values per cut of a group's order that one task sorts, and bounds of the number of cuts.
PER_CUT, LEAST_CUTS, MOST_CUTS = 100_000, 16, 4_000


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, ties, rank): the average rank of each distinct value within its group, counting from 1. Nulls have none."""
    per = materialise(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties")), "ranks-values")
    by = list(by)
    cuts = min(MOST_CUTS, max(LEAST_CUTS, -(-per.count() // PER_CUT)))
    edges = per.groupBy(*by).agg(F.percentile_approx(value, F.expr("array(" + ", ".join(f"{i / cuts:.6f}D" for i in range(1, cuts)) + ")"), F.lit(20 * cuts)).alias("edges"))
    cut = _below("edges", F.col(value), cuts)
    cutted = (checked_join(per, materialise(edges, "ranks-edges"), by, "left") if by else per.join(F.broadcast(edges), how="cross")).withColumn("cut", cut).drop("edges")
    sums = cutted.groupBy(*by, "cut").agg(F.sum("ties").alias("t"))
    below = sums.withColumn("below", F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    placed = checked_join(cutted, materialise(below, "ranks-below"), [*by, "cut"], "left")
    inside = F.sum("ties").over(Window.partitionBy(*by, "cut").orderBy(value))
    return placed.withColumn("upto", inside + F.col("below")).select(*by, value, "ties", (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"))


def _below(edges: str, value: Column, most: int) -> Column:
    """How many of the sorted edges (at most ``most``) are less than the value, by halving."""
    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = F.get(edges, mid) < value
        return F.when(a["lo"] >= a["hi"], a).when(less, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(edges), F.lit(0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, most).bit_length())), start, halved)["lo"]


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The exact median per group, from ranks of its distinct values, so that no group is gathered; null where a group has no value."""
    by = list(by)
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")  # null is a group as others are
    rows = df.select(*by, key.alias("__k"), not_nan(F.col(value).cast("double")).alias("__v"))
    ranks = value_ranks(rows, ["__k"], "__v").withColumn("__upto", F.col("rank") + (F.col("ties") - 1) / 2)
    sizes = materialise(rows.groupBy(*by, "__k").agg(F.count("__v").alias("__n")), "median-sizes")
    at = lambda place: F.min(F.when(F.col("__upto") >= place, F.col("__v")))
    met = sizes.join(ranks, "__k", "left").groupBy("__k", *by).agg(at(F.floor((F.col("__n") + 1) / 2)).alias("__a"), at(F.ceil((F.col("__n") + 1) / 2)).alias("__b"))
    return met.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias(name))


def small_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average ranks within groups known to be small (one row per label)."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by ranks (Mann-Whitney), n of each class. label is 0 or 1."""
    df = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranks = value_ranks(df, [], score)
    ones = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("ones"), F.count("*").alias("all"))
    got = ones.join(ranks, score).agg(F.sum(F.col("ones") * F.col("rank")).alias("r"), F.sum("ones").alias("n1"), F.sum(F.col("all") - F.col("ones")).alias("n0"))
    return got.select(((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"), "n1", "n0")


def neighbours(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Previous and next value, place and number of places within groups of bounded size."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select("*", F.lag(order).over(w).alias("prev"), F.lead(order).over(w).alias("next"), F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy(*by)).alias("places"))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest order of each group, as an aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def numbered(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Global row numbers without gathering the rows: range partitions are counted, then offset."""
    parts = materialise(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")  # one row per partition
    w = Window.partitionBy("__p").orderBy(*order)
    return parts.join(F.broadcast(before), "__p").withColumn(name, F.row_number().over(w) + F.col("__b")).drop("__p", "__b")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all if fewer), the same for the same seed and keys, without a sort of all rows."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """Adds is_test: the first floor(test x n) rows of each class in key order. Places come from value_ranks, so no class is sorted in one task."""
    one = df.groupBy(label, key).agg(F.count("*").alias("__n"))
    ranks = value_ranks(one, [label], key).select(label, key, F.col("rank").alias("__r"))
    sizes = materialise(one.groupBy(label).agg(F.count("*").alias("__all")), "split-sizes")
    return checked_join(df.join(ranks, [label, key]), sizes, [label]).withColumn("is_test", F.col("__r") <= F.floor(F.col("__all") * test)).drop("__r", "__all")


def cyclic_assignment(items: DataFrame, item: str, group: str, pool: dict[str, Sequence[str]], seed: int = 42) -> DataFrame:
    """Gives each item of a group one entry of the group's pool: no entry comes again before the pool is used up, and each turn has its own order."""
    rows = [(g, i, q) for g, qs in pool.items() for i, q in enumerate(qs)]
    entries = items.sparkSession.createDataFrame(rows, f"{group} string, __i int, entry string")
    sizes = items.sparkSession.createDataFrame([(g, len(qs)) for g, qs in pool.items()], f"{group} string, __size int")
    keyed = items.withColumn("__h", F.xxhash64(F.col(item), F.lit(seed)))
    places = value_ranks(keyed, [group], "__h").select(group, "__h", F.col("rank").cast("bigint").alias("__r"))
    dealt = keyed.join(places, [group, "__h"]).join(F.broadcast(sizes), group).withColumn("__turn", F.floor((F.col("__r") - 1) / F.col("__size")))
    slot = F.pmod(F.col("__r") - 1 + F.pmod(F.xxhash64("__turn", F.lit(seed)), F.col("__size").cast("bigint")), F.col("__size").cast("bigint")).cast("int")
    return dealt.withColumn("__i", slot).join(F.broadcast(entries), [group, "__i"]).select(*items.columns, "entry")


def first_gap(df: DataFrame, by: Sequence[str], counter: str) -> DataFrame:
    """The least number from 1 on that a group's counters leave free: the first counter that is not its own rank ends the run."""
    ranks = value_ranks(df.select(*by, F.col(counter).cast("bigint").alias("c")).filter("c >= 1").distinct(), by, "c")
    return ranks.groupBy(*by).agg((F.coalesce(F.max(F.when(F.col("rank") == F.col("c"), F.col("c"))), F.lit(0)) + 1).alias("next_free"))
