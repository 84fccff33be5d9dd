"""Paired and grouped statistics. Counts and sums are aggregates; distribution tails are computed on the few result rows.

Statistics that need n of a group give null below it. Nulls and NaN are left out pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import not_nan, unordered_pairs
from .windows import small_ranks, value_ranks


# Tails of distributions

def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - lead * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_tail(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def normal_tails(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def f_tail(f: float, d1: float, d2: float) -> float:
    return _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def studentised_range_tail(q: float, k: float, df: float) -> float:
    """Chance that the range of k means, in pooled standard errors with df degrees of freedom, exceeds q (Tukey): a sum over the deviation of the pooled error of the normal range's law."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    dense = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    spread = 6 / math.sqrt(2 * df)
    s = np.linspace(max(1e-6, 1 - spread), 1 + spread, 401) if df < 20_000 else np.array([1.0])
    # The pooled deviation's law (a scaled chi), normalised on the grid.
    log = (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(log - log.max())
    shifted = np.interp(z[None, :] - q * s[:, None], z, below, left=0.0, right=1.0)
    inside = k * np.trapezoid(dense * (below - shifted) ** (k - 1), z, axis=1)
    return float(min(1.0, max(0.0, 1 - (weight * inside).sum() / weight.sum())))


def signed_rank_p(w: float, n: int) -> float:
    """Exact two-sided p of the smaller signed-rank sum w of n differences without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return min(1.0, 2 * float(ways[: int(w) + 1].sum() / 2.0**n))


def _mapped(f, *types):
    return F.pandas_udf(lambda *cols: pd.Series([None if any(pd.isna(x) for x in xs) else f(*xs) for xs in zip(*cols)], dtype="float64"), T.DoubleType())


# Bootstrap

def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, n_boot: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the group means by a Poisson bootstrap: every row enters each resample Poisson(1) times.

    Equal values of a group are counted first; c of them together enter a resample Poisson(c) times, which is the same law.
    The draws come from the value's hash and the seed, so no partitioning changes the result, and the partial sums of all
    resamples are made where the values lie. Per group: n, mean, low, high; rows with a null or NaN value do not count.
    """
    by = list(by)
    rows = df.select(*by, not_nan(F.col(value).cast("double")).alias("v")).filter("v is not null")
    counted = rows.groupBy(*by, "v").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64(*(F.col(x).cast("string") for x in by), "v", F.lit(seed)))
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("s", T.BinaryType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                acc = sums.setdefault(tuple(key) if isinstance(key, tuple) else (key,), np.zeros((2, n_boot + 1)))
                for v, c, h in zip(g["v"], g["c"], g["h"]):
                    w = np.random.Generator(np.random.Philox(key=int(h) & (2**64 - 1))).poisson(c, n_boot)
                    acc[0, 0] += c
                    acc[1, 0] += c * v
                    acc[0, 1:] += w
                    acc[1, 1:] += v * w
        yield pd.DataFrame([(*k, a.tobytes()) for k, a in sums.items()], columns=[*by, "s"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        a = sum(np.frombuffer(b).reshape(2, -1) for b in pdf["s"])
        means = a[1, 1:] / np.maximum(a[0, 1:], 1)
        low, high = np.quantile(means, [(1 - ci) / 2, (1 + ci) / 2])
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in by), int(a[0, 0]), float(a[1, 0] / a[0, 0]), float(low), float(high))], columns=[*by, "n", "mean", "low", "high"])

    out = T.StructType([*(rows.schema[c] for c in by), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return counted.mapInPandas(partial, schema).groupBy(*by).applyInPandas(final, out)  # one small row per task and group


# Rank tests over blocks

def complete_blocks(df: DataFrame, block: str, label: str, labels: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, block, label, value): mean per block and label, of blocks that have all labels."""
    by = list(by)
    means = df.filter(F.col(label).isin(*labels)).groupBy(*by, block, label).agg(F.avg(not_nan(F.col(value).cast("double"))).alias("value")).filter("value is not null")
    means = means.select(*by, F.col(block).alias("block"), F.col(label).alias("label"), "value")
    full = means.groupBy(*by, "block").agg(F.count("*").alias("k")).filter(F.col("k") == len(labels))
    same = lambda c: F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    return means.alias("m").join(full.alias("f"), [*(same(c) for c in by), F.col("m.block") == F.col("f.block")], "left_semi")


def friedman(df: DataFrame, block: str, label: str, labels: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group of ``by`` that has a complete block): chi2 (corrected for ties), p, n blocks, k labels, w_code = chi2 / (k (n - 1)), w_textbook = chi2 / (n (k - 1)); null below 2 blocks or labels."""
    k, by = len(labels), list(by)
    blocks = complete_blocks(df, block, label, labels, value, by)
    ranks = small_ranks(blocks, [*by, "block"], "value")
    ties = blocks.groupBy(*by, "block", "value").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranks.groupBy(*by, "label").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").alias("n"))
    n = F.col("n")
    chi = (12 * F.col("rr") / (n * k * (k + 1)) - 3 * n * (k + 1)) / F.nullif(1 - F.col("ties") / (n * k * (k * k - 1)), F.lit(0.0))
    met = sums.alias("s").join(ties.alias("t"), [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]) if by else sums.join(ties, how="cross")  # one row each
    got = met.select(*(F.col(f"s.{c}") for c in by), F.when((n >= 2) & F.lit(k >= 2), chi).alias("chi2"), n.alias("n_blocks"), F.lit(k).alias("k"))
    got = got.withColumn("w_code", F.col("chi2") / F.nullif(k * (F.col("n_blocks") - 1), F.lit(0))).withColumn("w_textbook", F.col("chi2") / F.nullif(F.col("n_blocks") * (k - 1), F.lit(0)))
    return got.withColumn("p", _mapped(lambda c: chi2_tail(c, k - 1))(F.col("chi2")))


def wilcoxon_pairs(df: DataFrame, block: str, label: str, labels: Sequence[str], value: str, least: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group of ``by`` and) pair of labels: n blocks, n nonzero differences, W (the smaller rank sum), z, r = |z| / sqrt(n), p two-sided by the normal law with tie correction (exact up to 50 without ties), p_bonferroni over all pairs.

    Zero differences are dropped from the ranks, not from n; fewer than ``least`` blocks or no difference give null tests.
    """
    by = list(by)
    means = df.filter(F.col(label).isin(*labels)).groupBy(*by, F.col(block).alias("block"), F.col(label).alias("label")).agg(F.avg(not_nan(F.col(value).cast("double"))).alias("value")).filter("value is not null")
    pairs = unordered_pairs(means, [*by, "block"], "label", "value").withColumn("d", F.round(F.col("value_a") - F.col("value_b"), 9)).withColumn("size", F.abs("d"))
    ranks = value_ranks(pairs.filter("d <> 0"), [*by, "a", "b"], "size")
    sums = pairs.filter("d <> 0").groupBy(*by, "a", "b", "size").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")).join(ranks, [*by, "a", "b", "size"])
    tested = sums.groupBy(*by, "a", "b").agg(F.sum(F.col("up") * F.col("rank")).alias("w_up"), F.sum(F.col("down") * F.col("rank")).alias("w_down"), F.sum("ties").alias("m"), F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("tt"))
    n = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    m, ok = F.col("m"), F.col("n") >= least
    both = n.join(tested, [*by, "a", "b"], "left").withColumn("w", F.when(ok, F.least("w_up", "w_down")))
    nn = F.col("n")
    z = (F.col("w") - nn * (nn + 1) / 4) / F.sqrt(nn * (nn + 1) * (2 * nn + 1) / 24)
    zt = (F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("tt") / 48)
    exact = _mapped(lambda w, m, tt, z: signed_rank_p(w, int(m)) if m <= 50 and tt == 0 else normal_tails(z))
    count = len(labels) * (len(labels) - 1) // 2
    out = both.withColumn("z", z).withColumn("r", F.abs("z") / F.sqrt(nn)).withColumn("p", exact(F.col("w").cast("double"), m.cast("double"), F.col("tt").cast("double"), zt))
    return out.select(*by, "a", "b", "n", F.coalesce(m, F.lit(0)).alias("n_nonzero"), "w", "z", "r", "p", F.least(F.col("p") * count, F.lit(1.0)).alias("p_bonferroni"))


# Agreement and variance

def weighted_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa with linear weights on the places of the labels that occur; null below two pairs or without expected disagreement."""
    by = list(by)
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    entry = F.struct("x", "y", "c")
    table = cells.groupBy(*by).agg(F.collect_list(entry).alias("cells"), F.sum("c").alias("n"))  # labels x labels entries
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("cells", lambda t: t["x"]), F.transform("cells", lambda t: t["y"]))))
    table = table.withColumn("labels", labels)
    place = lambda v: F.array_position(F.col("labels"), v)
    placed = table.select(*by, "n", F.transform("cells", lambda t: F.struct(place(t["x"]).alias("i"), place(t["y"]).alias("j"), t["c"].alias("c"))).alias("cells"))
    seen = F.aggregate("cells", F.lit(0.0), lambda acc, t: acc + F.abs(t["i"] - t["j"]) * t["c"])
    expected = F.aggregate("cells", F.lit(0.0), lambda acc, t: acc + F.aggregate("cells", F.lit(0.0), lambda s, u: s + F.abs(t["i"] - u["j"]) * t["c"] * u["c"]))
    return placed.select(*by, "n", F.when(F.col("n") >= 2, 1 - seen / F.nullif(expected / F.col("n"), F.lit(0.0))).alias("kappa"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F, degrees of freedom, p of the one-way analysis of variance."""
    v = not_nan(F.col(value).cast("double"))
    per = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).filter("n > 0")
    tot = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("s")).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = ((F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")) / F.nullif(d1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(d2, F.lit(0)), F.lit(0.0))
    return tot.select(f.alias("f"), d1.alias("df_between"), d2.alias("df_within")).withColumn("p", _mapped(f_tail)(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def pairwise_differences(df: DataFrame, group: str, value: str) -> DataFrame:
    """Differences of group means with the pooled standard error, Tukey's q and its p."""
    v = not_nan(F.col(value).cast("double"))
    per = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).filter("n > 0")
    pooled = per.agg((F.sum(F.col("n") * F.col("s")) / F.nullif(F.sum("n") - F.count("*"), F.lit(0))).alias("mse"), (F.sum("n") - F.count("*")).cast("double").alias("free"), F.count("*").cast("double").alias("k"))
    each = per.agg(F.sort_array(F.collect_list(F.struct("g", "n", "m"))).alias("all")).join(pooled, how="cross")  # one row each
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter("all", lambda y, j: j > i), lambda y: F.struct(x["g"].alias("a"), y["g"].alias("b"), (y["m"] - x["m"]).alias("difference"), (1 / x["n"] + 1 / y["n"]).alias("inv")))))
    rows = each.select(F.explode(pairs).alias("p"), "mse", "k", "free").select("p.a", "p.b", "p.difference", F.sqrt(F.col("mse") / 2 * F.col("p.inv")).alias("se"), "k", "free")
    rows = rows.withColumn("q", F.abs("difference") / F.nullif("se", F.lit(0.0)))
    return rows.withColumn("p", _mapped(studentised_range_tail)(F.col("q"), F.col("k"), F.col("free"))).drop("k", "free")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation of x and y and their mean absolute difference."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("c"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = value_ranks(rows, [], x).select(x, F.col("rank").alias("rx"))
    ry = value_ranks(rows, [], y).select(y, F.col("rank").alias("ry"))
    p = both.join(rx, x).join(ry, y)
    c = F.col("c")
    s = p.agg(F.sum(c).alias("n"), F.sum(c * F.col("rx")).alias("sx"), F.sum(c * F.col("ry")).alias("sy"), F.sum(c * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(c * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(c * F.col("ry") * F.col("ry")).alias("syy"), (F.sum(c * F.abs(F.col(x) - F.col(y))) / F.sum(c)).alias("mae"))
    n = F.col("n")
    rho = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy")), F.lit(0.0))
    return s.select(rho.alias("rho"), "mae", "n")
