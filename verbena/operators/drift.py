"""Schemas that drift between files: profile fields per file, match renames, unify the records.

Each file's fields are profiled (JSON types, least hashes of value tokens and value shapes, numeric
range), and the profiles of a name are merged over its whole feed. Between consecutive files of a
series, fields that went and fields that came form a bipartite graph whose edges weigh likeness of
values, of types and of names; the best matching gives the renames. Two names that stand side by side
in any file of the feed are different fields and are never matched.

Defined results: null and "N/A" values have no type; a payload that is null, unreadable or no object
has no fields; repeated records count once; in nested containers only their members are fields;
empty tables give empty results; keys are compared with their case; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import checked_join, materialise, spread
from .windows import numbered

#: A sketch has the least KEPT hashes of value tokens, and as many of value shapes, however many there are.
KEPT = 512
#: Least weight of a matched pair.
LEAST = 0.42
#: Files in which two names should have met before their never meeting counts in full, and what it then adds.
EXPECTED, APART = 3.0, 0.1
#: Likeness of the values of two boolean fields.
SAME_BOOLEAN = 0.42
MISSING = "N/A"
_KINDS = ["array", "boolean", "number", "object", "string"]
_SERIES = ["producer", "feed"]
_FILE = [*_SERIES, "file_seq", "file_name"]
_SIDE = ("field_path", "low", "high", "broken", "sketch")


def fields(records: DataFrame, nested: dict[str, tuple[str, ...]]) -> DataFrame:
    """(records' columns without payload, field_path, value variant): one row per key of each record. ``nested``: per feed, objects whose members are the fields."""
    base = [c for c in records.columns if c != "payload"]
    doc = F.try_parse_json("payload")
    rows = records.withColumn("__doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)).filter("__doc is not null").drop("payload")
    view = "__verbena_docs"
    rows.createOrReplaceTempView(view)
    cols = ", ".join(f"d.`{c}`" for c in base)
    top = rows.sparkSession.sql(f"select {cols}, e.key as field_path, e.value as value from {view} d, lateral variant_explode(d.__doc) e")
    inner = F.lit(False)
    for feed, names in nested.items():
        inner |= (F.col("feed") == feed) & F.col("field_path").isin(*names)
    out = top.filter(~inner)
    objects = top.filter(inner & F.schema_of_variant("value").startswith("OBJECT"))
    objects.createOrReplaceTempView(view + "_in")
    cols = ", ".join(f"d.`{c}`" for c in base)
    members = rows.sparkSession.sql(f"select {cols}, concat(d.field_path, '.', e.key) as field_path, e.value as value from {view}_in d, lateral variant_explode(d.value) e")
    return out.unionByName(members)


def json_type(value) -> F.Column:
    """string, number, boolean, array, object, or null for null and "N/A"."""
    s = F.schema_of_variant(value)
    kind = F.when(s == "VOID", None).when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    return F.when((s == "STRING") & (F.try_variant_get(value, "$", "string") == MISSING), None).otherwise(kind)


def members(rows: DataFrame) -> DataFrame:
    """(rows' columns without value, member, text): nothing of a value is left out.

    An array of one element counts as that element; every other array, and an object without "valor", is JSON text. An object
    with it gives that as the value (member null) and a row more for each of its other members.
    """
    one = F.when(F.size(F.try_variant_get("value", "$", "array<variant>")) == 1, F.try_variant_get("value", "$[0]", "variant")).otherwise(F.col("value"))
    rows = rows.withColumn("value", F.when(json_type("value").isNotNull(), one))
    parts = F.try_variant_get("value", "$", "map<string, variant>")
    inside = F.when(F.map_contains_key(parts, F.lit("valor")), F.transform(F.map_entries(parts), lambda e: F.struct(F.nullif(e["key"], F.lit("valor")).alias("member"), e["value"].alias("value"))))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("member"), F.col("value").alias("value")))
    rows = rows.withColumn("__part", F.explode(F.coalesce(inside, whole)))
    rows = rows.select(*(c for c in rows.columns if c not in ("value", "__part")), "__part.member", "__part.value")
    s = F.schema_of_variant("value")
    text = F.when(s.startswith("ARRAY") | s.startswith("OBJECT"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    return rows.withColumn("text", text).drop("value")


def _marks(hashes, kind: int) -> F.Column:
    """62 bits of each hash, and the last bit the kind."""
    return F.transform(hashes, lambda h: F.shiftleft(F.shiftrightunsigned(h, 2), 1).bitwiseOR(F.lit(kind).cast("bigint")))


def _bottom(rows: DataFrame, by: list[str], facts: dict[str, Callable]) -> DataFrame:
    """(by, facts, sketch): the KEPT least marks of each kind, ascending. rows: by, facts' columns, mark (null in the rows that hold the facts).

    Repeated marks are merged map-side first, and each task sends on no more than KEPT per group.
    """
    one = rows.groupBy(*by, "mark").agg(*(f(c).alias(c) for c, f in facts.items()))
    place = F.row_number().over(Window.partitionBy(*by, F.col("mark").bitwiseAND(F.lit(1).cast("bigint"))).orderBy("mark"))
    least = one.withColumn("__place", place).filter(F.col("__place") <= KEPT)
    return least.groupBy(*by).agg(*(f(c).alias(c) for c, f in facts.items()), F.sort_array(F.collect_list("mark")).alias("sketch"))


def profile(rows: DataFrame) -> DataFrame:
    """One row per file and field: types, sketch and range. Every aggregate is bounded and merged map-side."""
    kind = json_type("value")
    text = F.when(kind.isin("array", "object"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    shape = F.regexp_replace(F.regexp_replace(text, r"\p{N}+", "9"), r"\p{L}+", "a")
    one = rows.select(*_FILE, "field_path", kind.alias("kind"), text.alias("text"), shape.alias("shape"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0))
    shapes = F.when(F.length("shape") > 2, F.array(F.xxhash64("shape"))).otherwise(F.array().cast("array<bigint>"))
    number = F.when(F.col("kind") == "number", F.col("text").try_cast("double"))
    code = F.coalesce(*(F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(_KINDS)), F.lit(0))
    one = one.withColumn("low", number).withColumn("high", number).withColumn("broken", F.when(number % 1 != 0, 1).otherwise(0)).withColumn("code", code)
    marks = F.when(F.col("kind").isNotNull(), F.concat(_marks(F.transform(words, lambda t: F.xxhash64(t)), 0), _marks(shapes, 1)))
    facts = {"code": F.bit_or, "low": F.min, "high": F.max, "broken": F.max}
    marked = one.select(*_FILE, "field_path", *facts, F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(marks, F.array().cast("array<bigint>")))).alias("mark"))
    kinds = F.filter(F.array(*(F.when(F.col("code").bitwiseAND(F.lit(1 << i)) > 0, F.lit(k)) for i, k in enumerate(_KINDS))), F.isnotnull)
    return _bottom(marked, [*_FILE, "field_path"], facts).select(*_FILE, "field_path", kinds.alias("kinds"), "low", "high", "broken", "sketch")


def of_feed(files: DataFrame) -> DataFrame:
    """The profiles of each name merged over the feed."""
    marked = files.select("feed", "field_path", "low", "high", "broken", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "sketch")).alias("mark")).withColumn("n_files", F.col("mark").isNull().cast("bigint"))
    return _bottom(marked, ["feed", "field_path"], {"low": F.min, "high": F.max, "broken": F.max, "n_files": F.sum})


_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_likeness(a: str, b: str) -> float:
    """1 for names equal but for case and separators; else the better of trigram overlap and shared words."""
    x, y = (re.sub(r"[\W_]+", "", s).casefold() for s in (a, b))
    if x == y:
        return 1.0
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    g = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    u, v = ({w.casefold() for w in _WORD.findall(s)} for s in (a, b))
    w = len(u & v) / max(1, min(len(u), len(v)))
    stems = {p[:4] for p in u if len(p) > 3} & {p[:4] for p in v if len(p) > 3}
    return max(g, 0.75 * w, 0.6 * bool(stems))


def _covered(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller set in the larger one: exact up to KEPT values; beyond, of the values below the bound up to which both sketches are whole."""
    upto = min((s[-1] for s in (a, b) if len(s) >= KEPT), default=None)
    x, y = (s if upto is None else s[s <= upto] for s in (a, b))
    return len(np.intersect1d(x, y)) / min(len(x), len(y)) if len(x) and len(y) else 0.0


def content_likeness(a, b) -> float:
    """Of two profiles of one type: shared tokens or shapes for texts, closeness of ranges for numbers."""
    if not (pd.isna(a.low) or pd.isna(b.low)):
        size = lambda p: np.log10(1 + max(abs(p.low), abs(p.high)))
        return 0.45 * max(0.0, 1 - abs(size(a) - size(b)) / 1.2) * (1.0 if a.broken == b.broken else 0.7)
    s, t = (np.asarray(p.sketch, np.int64) for p in (a, b))
    return max(_covered(s[s & 1 == 0], t[t & 1 == 0]), 0.8 * _covered(s[s & 1 == 1], t[t & 1 == 1]))


def _likeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Name and content likeness of pairs of names (o_ and n_ columns: their profiles over the feed)."""
    for pdf in batches:
        sides = [pdf[[f"{s}_{c}" for c in _SIDE]].set_axis(list(_SIDE), axis=1).itertuples(index=False) for s in "on"]
        pairs = list(zip(*sides))
        last = lambda p: p.field_path.rsplit(".", 1)[-1]
        yield pd.DataFrame({"feed": pdf["feed"], "old_path": [a.field_path for a, _ in pairs], "new_path": [b.field_path for _, b in pairs], "name": [name_likeness(last(a), last(b)) for a, b in pairs], "like": [content_likeness(a, b) for a, b in pairs], "apart": pdf["apart"]})


def weight() -> F.Column:
    """Weight of a pair by name, like, apart and the kinds both have in their files (o_kinds, n_kinds)."""
    name, like, both = F.col("name"), F.col("like"), F.array_intersect("o_kinds", "n_kinds")
    plain = F.size(F.array_except(both, F.array(F.lit("number"), F.lit("boolean")))) == 0  # their values say little
    like_plain = F.when((F.size(both) == 1) & (both[0] == "boolean"), SAME_BOOLEAN).otherwise(like)
    # By chance, names so frequent would have met in a file; that they never do is some evidence that one replaces the other.
    return (
        F.when((F.size("o_kinds") == 0) | (F.size("n_kinds") == 0), F.when(name >= 0.6, name))
        .when(F.size(both) == 0, F.when(name >= 0.9, name))
        .when(plain, 0.65 * name + 0.8 * like_plain + APART * F.col("apart"))
        .otherwise(0.45 * name + 0.75 * like)
    )


def best_matching(w: np.ndarray) -> list[tuple[int, int]]:
    """Heaviest bipartite matching by shortest augmenting paths (potentials); pairs without weight are left out."""
    n, m = w.shape
    if n > m:
        return [(i, j) for j, i in best_matching(w.T)]
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)  # place 0 stands for none
    cost = np.zeros((n + 1, m + 1))
    cost[1:, 1:] = -w
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            c = cost[owner[j0], free] - u[owner[j0]] - v[free]
            better = c < low[free]
            low[free[better]], way[free[better]] = c[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[free] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j] and w[owner[j] - 1, j - 1] > 0]


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    """The best matching of one file's pairs (old_path, new_path, weight)."""
    old, new = sorted(set(rows.old_path)), sorted(set(rows.new_path))
    w = np.zeros((len(old), len(new)))
    for a, b, x in zip(rows.old_path, rows.new_path, rows.weight):
        w[old.index(a), new.index(b)] = x
    file = {c: rows[c].iloc[0] for c in _FILE}
    return pd.DataFrame([file | {"old_path": old[i], "new_path": new[j], "weight": float(w[i, j])} for i, j in best_matching(w)], columns=[*_FILE, "old_path", "new_path", "weight"])


class Drift:
    """Changes between consecutive files of each (producer, feed) series, by file_seq then file_name.

    records: producer, feed, file_name, file_seq, payload; ``nested``: see ``fields``.
    """

    def __init__(self, records: DataFrame, nested: dict[str, tuple[str, ...]] | None = None):
        self.rows = fields(records.select(*dict.fromkeys([*_FILE, *(c for c in ("record_id", "written_at") if c in records.columns)]), "payload"), nested or {})
        self.profile = materialise(profile(self.rows), "drift-profile")
        files = self.profile.select(*_FILE).distinct()
        known = materialise(records.select(*_FILE).distinct().unionByName(files).distinct(), "drift-files")
        # A series may hold a third of all files: their order comes from range partitions, not from a sort of the series.
        order = materialise(numbered(known, _FILE), "drift-order")
        step = lambda k, name: order.select(*_SERIES, (F.col("n") + k).alias("n"), F.struct("file_seq", "file_name").alias(name))
        order = order.join(step(-1, "next"), [*_SERIES, "n"], "left").join(step(1, "before"), [*_SERIES, "n"], "left").withColumn("first", F.col("before").isNull())
        p = self.profile.join(order.select(*_FILE, "next", "first"), _FILE)
        now = p.filter(~F.col("first")).select(*_FILE, "field_path", F.col("kinds").alias("n_kinds"))
        before = p.filter("next is not null").select(*_SERIES, F.col("next.file_seq").alias("file_seq"), F.col("next.file_name").alias("file_name"), "field_path", F.col("kinds").alias("o_kinds"))
        self.pairs = materialise(now.join(before, [*_FILE, "field_path"], "full"), "drift-pairs")
        self.renames = materialise(self._renames(), "drift-renames")

    def _renames(self) -> DataFrame:
        gone = self.pairs.filter("n_kinds is null").select(*_FILE, F.col("field_path").alias("old_path"), "o_kinds")
        new = self.pairs.filter("o_kinds is null").select(*_FILE, F.col("field_path").alias("new_path"), "n_kinds")
        parent = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
        cand = materialise(gone.join(new, _FILE).filter(parent("old_path") == parent("new_path")), "drift-candidates")
        names = materialise(cand.select("feed", "old_path", "new_path").distinct(), "drift-names")
        have = checked_join(self.profile.select(*_FILE, F.col("field_path").alias("old_path")), names, ["feed", "old_path"], salt_on=["file_name"])
        beside = have.join(self.profile.select(*_FILE, F.col("field_path").alias("new_path")), [*_FILE, "new_path"], "left_semi").select("feed", "old_path", "new_path").distinct()
        names = names.join(beside, ["feed", "old_path", "new_path"], "left_anti")
        # Each pair of names is compared once per feed, however many files it stands in.
        totals = self.profile.select(*_FILE).distinct().groupBy("feed").agg(F.count("*").alias("n_total"))
        named = materialise(of_feed(self.profile).join(totals, "feed"), "drift-named")
        side = lambda s: named.select("feed", "n_total", *(F.col(c).alias(f"{s}_{c}") for c in (*_SIDE, "n_files")))
        both = names.join(side("o").withColumn("old_path", F.col("o_field_path")), ["feed", "old_path"]).join(side("n").drop("n_total").withColumn("new_path", F.col("n_field_path")), ["feed", "new_path"])
        apart = F.least(F.lit(1.0), F.col("o_n_files") * F.col("n_n_files") / F.greatest(F.lit(1.0), EXPECTED * F.col("n_total")))
        told = spread(both.select("feed", *(f"{s}_{c}" for s in "on" for c in _SIDE), apart.alias("apart")), "o_field_path", "n_field_path")
        likeness = materialise(told.mapInPandas(_likeness, "feed string, old_path string, new_path string, name double, like double, apart double"), "drift-likeness")
        edges = checked_join(cand, likeness, ["feed", "old_path", "new_path"], salt_on=["file_name"]).withColumn("weight", weight()).filter(F.col("weight") >= LEAST)
        edges = edges.select(*_FILE, "old_path", "new_path", "weight")
        met = lambda c: F.count("*").over(Window.partitionBy(*_FILE, c))
        edges = materialise(edges.withColumn("alone", (met("old_path") == 1) & (met("new_path") == 1)), "drift-edges")
        # Pairs whose names have no other pair in the file belong to every best matching; only the others are matched file by file.
        some = edges.filter("not alone").drop("alone")
        binned = spread(some.withColumn("__bin", F.xxhash64(*_FILE)), "__bin")
        return edges.filter("alone").drop("alone").unionByName(binned.groupBy("__bin", *_FILE).applyInPandas(_match, some.schema))

    def changes(self) -> DataFrame:
        """(_FILE, field_path, change_kind): added, removed, renamed, type_changed."""
        kind = F.when(F.col("o_kinds").isNull(), "added").when(F.col("n_kinds").isNull(), "removed").when((F.size("o_kinds") > 0) & (F.size("n_kinds") > 0) & (F.col("o_kinds") != F.col("n_kinds")), "type_changed")
        plain = self.pairs.withColumn("change_kind", kind).filter("change_kind is not null").select(*_FILE, "field_path", "change_kind")
        ends = self.renames.select(*_FILE, F.explode(F.array(F.struct(F.col("old_path").alias("p"), F.lit("removed").alias("k")), F.struct(F.col("new_path").alias("p"), F.lit("added").alias("k")))).alias("e")).select(*_FILE, F.col("e.p").alias("field_path"), F.col("e.k").alias("change_kind"))
        renamed = self.renames.select(*_FILE, F.col("new_path").alias("field_path"), F.lit("renamed").alias("change_kind"))
        return plain.join(ends, [*_FILE, "field_path", "change_kind"], "left_anti").unionByName(renamed)

    def canonical_names(self) -> DataFrame:
        """(feed, field_path, name): names joined by renames take that of the most files. Collects names only, not rows."""
        count = {(r.feed, r.field_path): r.n for r in self.profile.groupBy("feed", "field_path").agg(F.count("*").alias("n")).collect()}
        root: dict[tuple[str, str], tuple[str, str]] = {k: k for k in count}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for r in self.renames.select("feed", "old_path", "new_path").distinct().orderBy("feed", "old_path", "new_path").collect():
            a, b = find((r.feed, r.old_path)), find((r.feed, r.new_path))
            root[b] = a
        groups = defaultdict(list)
        for k in count:
            groups[find(k)].append(k)
        best = {k: max(ks, key=lambda x: (count[x], x))[1] for g, ks in groups.items() for k in ks}
        return self.profile.sparkSession.createDataFrame([(f, p, n) for (f, p), n in sorted(best.items())], "feed string, field_path string, name string")

    def unified(self, feed: str) -> DataFrame:
        """One row per record of the feed, one column per field under its canonical name; numbers and booleans where all values are.

        What ``members`` tells apart has columns of its own: field_member. Arrays that are not of one element are JSON text.
        """
        names = {r.field_path: r.name for r in self.canonical_names().filter(F.col("feed") == feed).collect()}
        by_name: dict[str, list[tuple[str, str | None]]] = defaultdict(list)
        for path, name in names.items():
            by_name[name].append((path, None))
        rows = members(self.rows.filter(F.col("feed") == feed).select(*_FILE, "record_id", "field_path", "value"))
        for r in rows.filter("member is not null").select("field_path", "member").distinct().orderBy("field_path", "member").collect():  # names only
            by_name[f"{names[r.field_path]}.{r.member}"].append((r.field_path, r.member))
        aggs, used = [], Counter(c.lower() for c in [*_FILE, "record_id"])
        for name, paths in sorted(by_name.items()):
            col = name.replace(".", "_")
            used[col.lower()] += 1
            aggs.append(F.max(F.when(reduce(or_, ((F.col("field_path") == p) & F.col("member").eqNullSafe(m) for p, m in paths)), F.col("text"))).alias(col if used[col.lower()] == 1 else f"{col}_{used[col.lower()]}"))
        wide = rows.groupBy(*_FILE, "record_id").agg(*aggs) if aggs else rows.select(*_FILE, "record_id").distinct()
        return self._typed(wide)

    def _typed(self, wide: DataFrame) -> DataFrame:
        cols = [c for c in wide.columns if c not in (*_FILE, "record_id")]
        if not cols:
            return wide
        wide = materialise(wide, "drift-wide")
        num = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^(-?\d+),(\d+)$", "$1.$2").try_cast("double")
        bad = wide.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & num(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols))).first()
        return wide.select(*_FILE, "record_id", *((num(c) if bad[f"n{i}"] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(cols)))


__all__ = ["Drift", "best_matching", "fields", "json_type", "members", "name_likeness", "profile", "weight"]
