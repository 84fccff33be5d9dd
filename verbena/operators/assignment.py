"""Assignments that a log takes over: questions, personas, prompt values. All choices come from hashes of keys and a seed, so they are the same on every run and cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_join
from .relational import remap
from .windows import cyclic_assignment

# Order of the tiers that questions ask for; the rank of an unknown tier, and of a question without a known one.
TIER_RANKS = {"T1": 1, "T3": 3}
UNKNOWN_TIER, ANY_TIER = 99, 1


def seeded_choice(key: Column | str, options: Sequence, seed: int = 42) -> Column:
    """One of the options per key; null without options."""
    if not options:
        return F.lit(None)
    key = F.col(key) if isinstance(key, str) else key
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(options))).cast("int"))


def fitting(questions: DataFrame, persona: str | None = None, tier: str | None = None, personas: Sequence[str] | None = None, ranks: Mapping[str, int] = TIER_RANKS) -> DataFrame:
    """questions (persona, tier_min, ..) of a persona that a tier can answer; an unknown persona is an error, an unknown tier answers all."""
    if persona is not None:
        if personas is not None and persona not in personas:
            raise ValueError(f"there is no persona {persona!r}; there are {sorted(personas)}")
        questions = questions.filter(F.col("persona") == persona)
    if tier:
        rank = remap("tier_min", {k: str(v) for k, v in ranks.items()}, F.lit(str(ANY_TIER))).cast("int")
        questions = questions.filter(rank <= ranks.get(tier, UNKNOWN_TIER))
    return questions


def unlogged(items: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items whose keys the log does not have."""
    return items.join(log.select(*keys).distinct(), list(keys), "left_anti")


def assigned_questions(items: DataFrame, log: DataFrame, item: str, persona: str, pool: dict[str, Sequence[str]], seed: int = 42) -> DataFrame:
    """items (item, persona) that are not logged, each with an ``entry`` of its persona's pool: none comes again before the pool is used up. Items without a pool get none."""
    return cyclic_assignment(unlogged(items, log, [item, persona]), item, persona, pool, seed)


def personas(items: DataFrame, log: DataFrame, item: str, options: Sequence[str], fixed: str | None = None, seed: int = 42) -> DataFrame:
    """items with ``persona``: the fixed one, else the logged one, else a seeded choice. log: (item, persona), of repeated items the least."""
    if fixed is not None:
        return items.withColumn("persona", F.lit(fixed))
    known = log.groupBy(item).agg(F.min("persona").alias("__logged"))
    return checked_join(items, known, [item], "left").withColumn("persona", F.coalesce("__logged", seeded_choice(item, options, seed))).drop("__logged")


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Columns as texts with their default where they are null, blank or absent."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(d)) if c in have else F.lit(d) for c, d in defaults.items()})


def overridden(defaults: Mapping[str, str], overrides: Column) -> Column:
    """A map of the defaults in which non-blank overrides (map<string, string>) of known names win; unknown names are ignored."""
    got = {k: F.coalesce(F.nullif(F.trim(overrides[k]), F.lit("")), F.lit(v)) for k, v in defaults.items()}
    return F.create_map(*(x for k, v in got.items() for x in (F.lit(k), v)))


def merged(left: Column, right: Column, left_fields: Sequence[str], right_fields: Sequence[str]) -> Column:
    """Two structs as one; fields of both are the right one's, null or not."""
    return F.struct(*(left[f].alias(f) for f in left_fields if f not in right_fields), *(right[f].alias(f) for f in right_fields))
