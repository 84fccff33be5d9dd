"""Projections, filters, joins and set operations as functions of DataFrames.

Joins broadcast a side only after counting it (``runtime.checked_join``). Nulls never equal each other
in joins; columns that both sides have keep the left side's value unless a prefix is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical_key
from ..runtime import at_most, checked_join

#: Texts that mean "no value" in mixed columns.
MISSING = ("", "N/A", "NA", "nan", "NaN", "None", "null")


# Projections

def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns the table has, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def first_existing(df: DataFrame, candidates: Sequence[str], default=None) -> Column:
    """The first candidate column the table has, else a literal."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(default))


def excluding(df: DataFrame, *groups: Sequence[str]) -> list[str]:
    """Names of the columns in none of the groups."""
    out = {c for g in groups for c in g}
    return [c for c in df.columns if c not in out]


def matching(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """Names of the columns that contain any of the parts."""
    return [c for c in df.columns if any(p in c for p in parts)]


def with_constants(df: DataFrame, values: Mapping[str, object], first: bool = False) -> DataFrame:
    new = [F.lit(v).alias(k) for k, v in values.items()]
    return df.select(*new, "*") if first else df.select("*", *new)


def remap(c: Column | str, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Values replaced by a small table; others pass through, or take the default."""
    c = F.col(c) if isinstance(c, str) else c
    if not table:
        return c if default is None else default
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(pairs[c], c if default is None else default)


def fallback(*columns: str) -> Column:
    """The first column that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


# Values

def number(c: Column | str) -> Column:
    """Numbers of a mixed column; missing marks and other texts become null, booleans 1 and 0."""
    c = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(c.isin(*MISSING), None).when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).otherwise(c.try_cast("double"))


def state(c: Column | str) -> Column:
    """Which of the three states a mixed value has: number, not_applicable or missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c.cast("string")) == "N/A", "not_applicable").when(number(c).isNull(), "missing").otherwise("number")


def not_nan(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


# Filters

def folded_equals(df: DataFrame, **values: str) -> DataFrame:
    """Rows whose columns equal all values but for case."""
    return df.filter(reduce(lambda a, b: a & b, (F.lower(F.col(c)) == v.lower() for c, v in values.items()), F.lit(True)))


def in_range(df: DataFrame, column: str, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose text lies in any of the ranges, ends included, in code point order."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(column).between(lo, hi) for lo, hi in ranges), F.lit(False)))


def binomial(c: Column | str) -> Column:
    """Whether a name has two words or more of which the second begins small."""
    w = F.split(F.trim(F.col(c) if isinstance(c, str) else c), r"\s+")
    return (F.size(w) >= 2) & F.coalesce(F.get(w, F.lit(1)).rlike(r"^\p{Ll}"), F.lit(False))


def optionally(df: DataFrame, column: str, value) -> DataFrame:
    """Filter only if a value is given."""
    return df if value is None else df.filter(F.col(column) == value)


def differs(pairs: Sequence[tuple[str, str]], least: float) -> Column:
    """Whether any pair of columns is at least so far apart; pairs with a null do not count."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.abs(F.col(a) - F.col(b)) >= least, F.lit(False)) for a, b in pairs), F.lit(False))


def finished(df: DataFrame, key: str, kind: str, status: str = "status", done: str = "done") -> DataFrame:
    """Rows of a log whose key ends with |kind and whose status says done."""
    return df.filter(F.col(key).endswith("|" + kind) & (F.col(status) == done))


# Joins

def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    return prefixed(left, left_prefix, keys).join(prefixed(right, right_prefix, keys), list(keys), how)


def same_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Distinct keys of names both tables have, whatever case and separators."""
    a = left.select(canonical_key(left_name).alias("name_key")).filter("name_key <> ''").distinct()
    b = right.select(canonical_key(right_name).alias("name_key")).filter("name_key <> ''").distinct()
    return a.join(b, "name_key", "left_semi")


def lookup(df: DataFrame, dimension: DataFrame, keys: Sequence[str], value: str, default: Column) -> DataFrame:
    """Adds a dimension's value, or the default where it has none. The dimension has one row per key."""
    return checked_join(df, dimension.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, default))


def with_parents(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], value: str, default: Column | None = None) -> DataFrame:
    """Takes value from the first level that has the row's keys."""
    out, found = df, []
    for i, (level, keys) in enumerate(levels):
        out = checked_join(out, level.select(*keys, F.col(value).alias(f"__v{i}")), list(keys), "left")
        found.append(F.col(f"__v{i}"))
    return out.withColumn(value, F.coalesce(*found, *([default] if default is not None else []))).drop(*(f"__v{i}" for i in range(len(levels))))


def work_plan(dimensions: Sequence[DataFrame], done: DataFrame, keys: Sequence[str], max_rows: int = 10_000) -> DataFrame:
    """All combinations of small dimensions that are not done. All but the first are counted before they are multiplied."""
    first, *rest = dimensions
    for d in rest:
        if not at_most(d, max_rows):
            raise ValueError("a work plan multiplies its first table by small ones only")
        rows = [r.asDict() for r in d.collect()]
        options = F.array(*(F.struct(*(F.lit(v).cast(d.schema[k].dataType).alias(k) for k, v in r.items())) for r in rows))
        first = first.withColumn("__o", F.explode(options)).select("*", "__o.*").drop("__o") if rows else first.limit(0).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema))
    return first.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unordered_pairs(df: DataFrame, within: Sequence[str], label: str, value: str) -> DataFrame:
    """One row per pair of labels a < b within a group that has few labels (one row per label): a, b, value_a, value_b."""
    each = df.groupBy(*within).agg(F.sort_array(F.collect_list(F.struct(label, value))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter("all", lambda y, j: j > i), lambda y: F.struct(x[label].alias("a"), y[label].alias("b"), x[value].alias("value_a"), y[value].alias("value_b")))))
    return each.select(*within, F.explode(pairs).alias("p")).select(*within, "p.*")


def pattern_matches(df: DataFrame, text: str, patterns: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Adds codes: the union of the codes of all patterns found in the text. Patterns are a list in code, so the plan is one projection."""
    empty = F.array().cast("array<string>")
    found = [F.when(F.col(text).rlike(p), F.array(*map(F.lit, codes))).otherwise(empty) for p, codes in patterns]
    return df.withColumn("codes", F.sort_array(F.array_distinct(F.flatten(F.array(*found)))) if found else empty)


def table_matches(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", codes: str = "codes") -> DataFrame:
    """As pattern_matches with a table of patterns (few: it is counted and its rows become the plan's expressions)."""
    if not at_most(patterns, 10_000):
        raise ValueError("a pattern table holds at most 10000 patterns")
    rows = [(r[pattern], list(r[codes])) for r in patterns.select(pattern, codes).collect()]
    return pattern_matches(df, text, rows)


def merged_counts(counts: DataFrame, names: DataFrame, key: str, name: str, n: str = "n") -> DataFrame:
    """(name, n): counts per key summed per name; keys without a name stand as key_<key>."""
    named = lookup(counts, names, [key], name, F.concat(F.lit(f"{key}_"), F.col(key).cast("string")))
    return named.groupBy(name).agg(F.sum(n).alias(n))


def first_success(df: DataFrame, by: Sequence[str], order: str, ok: Column) -> DataFrame:
    """The first row of each group that passes a test."""
    rest = [c for c in df.columns if c not in by]
    return df.filter(ok).groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*by, "__r.*")


def in_bands(df: DataFrame, value: str, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """One row per band [low, high] that holds the value; a band table in code, so no join is needed."""
    inside = F.array(*(F.when(F.col(value).between(lo, hi), F.lit(name)) for name, lo, hi in bands))
    return df.withColumn("band", F.explode(F.filter(inside, lambda b: b.isNotNull())))


# Sets and shapes

def stacked(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def rows_not_in(df: DataFrame, other: DataFrame, key: str, keep_nulls: bool = True) -> DataFrame:
    """Rows whose key the other table does not have. Rows without a key stay (as a data frame's "not in" has it), or go with ``keep_nulls`` off (as SQL's)."""
    left = df if keep_nulls else df.filter(F.col(key).isNotNull())
    return left.join(other.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns)


def keys_missing(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    return left.select(key).distinct().join(right.select(F.col(right_key or key).alias(key)).distinct(), key, "left_anti")


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str = "") -> DataFrame:
    """One 0/1 column per category; nulls and other values are 0 in all."""
    return df.select("*", *(F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{prefix}{c}") for c in categories))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """target with new rows inserted and, of rows it has, only the ``update`` columns replaced. One update per key: the callers choose."""
    update = list(update) if update is not None else [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.lit(True).alias("__new"), *(F.col(c).alias(f"__u_{c}") for c in updates.columns if c not in keys))
    both = target.withColumn("__old", F.lit(True)).join(new, list(keys), "full")
    cols = []
    for c in target.columns:
        if c in keys or c not in updates.columns:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("__new"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__u_{c}")).alias(c))
    return both.select(*cols)


def insert_absent(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(new.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns))


def assigned(df: DataFrame, replacements: DataFrame, key: str) -> DataFrame:
    """Columns of the rows that have a replacement take its non-null values; one replacement per key."""
    cols = [c for c in replacements.columns if c != key and c in df.columns]
    r = replacements.select(key, *(F.col(c).alias(f"__r_{c}") for c in cols))
    return checked_join(df, r, [key], "left").select(*(F.coalesce(f"__r_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns))
