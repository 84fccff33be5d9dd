"""Mix sources to target weights along a curriculum.

A source's weight may change over training time t in [0, 1]: knots joined by straight lines, scaled so
that all weights add up to 1 at each knot and each source's integral is its target share. The integral
is the source's cumulative demand for tokens. Each source's documents stand in hash order, pass after
pass, with cumulative token counts; the time at which the demand reaches a document's place is its
training position, a root of a quadratic in the knot interval it falls into. Documents are then sorted
by position in ranges.

Without a given total, the mix is as large as the caps allow with every share met exactly: the least of
tokens x max_repeats / share. With a larger total, sources at their cap give all they may and the others
share the rest in proportion to their targets.

Cumulative counts are sums within hash buckets of bounded size plus sums over buckets, so no source is
ever sorted in one task.

Defined results: documents with a null or unlisted source, or without tokens, are left out; a listed
source without documents has share 0 and the others are scaled up; null or non-positive targets count
as 0, null max_repeats as 1; each listed source has one target (the largest, if repeated); repeated
doc_ids and repeated rows are separate documents; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import at_most, materialise, spread

#: Documents per bucket of a source's hash order.
BUCKET = 20_000
#: Change of a source's weight over the curriculum, from the shortest documents (early) to the longest (late).
TILT = 0.5
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoder(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the pattern byte-level vocabularies are split by.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, own, n_tokens), one row per row. ``own`` tells texts under one doc_id apart.

    ``tokenizer``: path of a vocabulary of ranks (about a megabyte); only the driver reads it, workers get it as a broadcast.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(vocabulary.value)
        for pdf in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "own": pdf["own"], "n_tokens": n})

    return documents.select("doc_id", "source", _own().alias("own"), "text").mapInPandas(run, "doc_id bigint, source string, own bigint, n_tokens int")


def _own() -> Column:
    return F.xxhash64("source", "text")


def allocate(have: dict[str, tuple[float, float]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens per source. have: source -> (tokens, documents); targets: source -> (share, max_repeats)."""
    live = {s: max(0.0, w) for s, (w, _) in targets.items() if have.get(s, (0, 0))[0] > 0 and w > 0}
    norm = sum(live.values())
    if not norm:
        return {}
    caps = {s: have[s][0] * max(1, targets[s][1]) for s in live}
    if total is None:
        total = min(caps[s] / (w / norm) for s, w in live.items())
    need: dict[str, float] = {}
    open_, rest = dict(live), float(total)
    while open_:
        scale = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * scale >= caps[s]]
        if not full:
            return need | {s: w * scale for s, w in open_.items()}
        for s in full:
            need[s] = caps[s]
            rest -= caps[s]
            del open_[s]
    return need


def tilted(shares: dict[str, float], length: dict[str, float], tilt: float = TILT) -> dict[str, list[tuple[float, float]]]:
    """Default curriculum: (t, weight) knots per source, sources of short documents first; weights add up to 1 at both ends."""
    order = sorted(shares, key=lambda s: (length[s], s))
    rank = {s: 1 - 2 * i / max(1, len(order) - 1) if len(order) > 1 else 0.0 for i, s in enumerate(order)}
    mean = sum(shares[s] * rank[s] for s in shares)
    move = {s: rank[s] - mean for s in shares}
    scale = tilt / max(1e-9, max(map(abs, move.values()), default=1.0))
    return {s: [(0.0, w * (1 + scale * move[s])), (1.0, w * (1 - scale * move[s]))] for s, w in shares.items()}


def segments(knots: dict[str, list[tuple[float, float]]], need: dict[str, float]) -> list[tuple[str, float, float, float, float, float, float]]:
    """(source, from, to, t0, t1, rate at t0, slope): demand in tokens from .. to between knots; scaled so that a source's last ``to`` is its need."""
    out = []
    for s, ks in knots.items():
        ks = sorted(ks)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(ks, ks[1:]))
        if area <= 0:
            ks, area = [(0.0, 1.0), (1.0, 1.0)], 1.0
        k, at = need[s] / area, 0.0
        for (t0, w0), (t1, w1) in zip(ks, ks[1:]):
            gain = k * (t1 - t0) * (w0 + w1) / 2
            if t1 > t0 and gain > 0:
                out.append((s, at, at + gain, t0, t1, k * w0, k * (w1 - w0) / (t1 - t0)))
                at += gain
    return out


def invert(c: Column) -> Column:
    """The time at which the demand of the row's segment reaches c: root of rate x + slope x² / 2 = c - from."""
    y = F.greatest(c - F.col("from"), F.lit(0.0))
    x = F.when(F.abs(F.col("slope")) < 1e-12, y / F.col("rate")).otherwise(2 * y / (F.col("rate") + F.sqrt(F.greatest(F.col("rate") * F.col("rate") + 2 * F.col("slope") * y, F.lit(0.0)))))
    return F.least(F.col("t0") + x, F.col("t1"))


class Mix:
    """documents: doc_id, text, source; targets: source, target_share, max_repeats; schedule: (source, t, weight) knots, or the default."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: float | None = None, schedule: DataFrame | None = None, seed: int = 0):
        spark = documents.sparkSession
        targets = targets.filter("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
        if not at_most(targets, 100_000):
            raise ValueError("more than 100000 sources have a target; weights are a table of sources, not of documents")
        self.targets = {r.source: (float(r.w), int(r.r)) for r in targets.collect()}
        counts = token_counts(documents, tokenizer).filter(F.col("n_tokens") > 0)
        copies = counts.groupBy("doc_id", "source", "own", "n_tokens").agg(F.count("*").alias("copies"))
        self.counts = materialise(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies"), "mix-tokens")
        have = {r.source: (float(r.t), float(r.n)) for r in self.counts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).filter(F.col("source").isin(*self.targets) if self.targets else F.lit(False)).collect()}
        self.have, self.need = have, allocate(have, self.targets, total)
        whole = sum(self.need.values())
        shares = {s: n / whole for s, n in self.need.items()}
        if schedule is None:
            knots = tilted(shares, {s: have[s][0] / have[s][1] for s in shares})
        else:
            knots = {}
            for r in schedule.collect():  # a few knots per source
                knots.setdefault(r.source, []).append((float(r.t), float(r.weight)))
            knots = {s: knots.get(s, [(0.0, 1.0), (1.0, 1.0)]) for s in shares}
        parts = segments(knots, self.need)
        self.plan = spark.createDataFrame(parts, 'source string, `from` double, `to` double, t0 double, t1 double, rate double, slope double')
        rows = [(s, self.need[s], have[s][0], int(-(-self.need[s] // have[s][0])), int(-(-have[s][1] // BUCKET))) for s in self.need]
        self.sizes = spark.createDataFrame(rows, "source string, need double, avail double, passes int, buckets int")
        self.seed = seed

    def positions(self) -> DataFrame:
        """(doc_id, own, copy, source, pass, n_tokens, position), unordered."""
        small = F.broadcast(self.sizes)  # one row per source, counted above
        docs = self.counts.join(small, "source").withColumn("pass", F.explode(F.sequence(F.lit(1), "passes")))
        docs = docs.withColumn("h", F.xxhash64("doc_id", "own", "copy", "pass", F.lit(self.seed))).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets").cast("bigint")).cast("int"))
        docs = spread(docs.select("doc_id", "own", "copy", "source", "pass", "n_tokens", "need", "avail", "h", "bucket"), "source", "pass", "bucket")
        inside = F.sum("n_tokens").over(Window.partitionBy("source", "pass", "bucket").orderBy("h", "doc_id", "own", "copy").rowsBetween(Window.unboundedPreceding, 0))
        docs = materialise(docs.withColumn("upto", inside), "mix-order")
        sums = docs.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
        before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source", "pass").orderBy("bucket")) - F.col("t")).drop("t")
        placed = docs.join(before, ["source", "pass", "bucket"]).withColumn("middle", (F.col("pass") - 1) * F.col("avail") + F.col("before") + F.col("upto") - F.col("n_tokens") / 2)
        placed = placed.filter("middle <= need")
        cut = placed.join(F.broadcast(self.plan), (placed["source"] == self.plan["source"]) & (F.col("middle") >= F.col("from")) & (F.col("middle") < F.col("to")))  # one segment each
        return cut.select("doc_id", "own", "copy", placed["source"].alias("source"), "pass", "n_tokens", invert(F.col("middle")).alias("position"))

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, n_tokens, n_docs, repeats): of every listed source."""
        got = self.positions().groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
        listed = self.sizes.sparkSession.createDataFrame([(s, w, self.have.get(s, (0.0, 0.0))[0]) for s, (w, _) in self.targets.items()], "source string, target_share double, avail double")
        both = listed.join(got, "source", "left").na.fill(0, ["n_tokens", "n_docs"])
        all_ = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
        return both.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.nullif(all_, F.lit(0)), F.lit(0.0)).alias("actual_share"), "n_tokens", "n_docs", F.coalesce(F.col("n_tokens") / F.nullif(F.col("avail"), F.lit(0.0)), F.lit(0.0)).alias("repeats"))


def mix(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The combined documents (position, doc_id, source, pass, n_tokens, text), sorted by position in ranges."""
    m = Mix(documents, targets, **options)
    placed = materialise(m.positions(), "mix-positions")
    # Equal rows are one text with several copies, so no row meets a text twice.
    texts = documents.select("doc_id", _own().alias("own"), "text").filter("text is not null").groupBy("doc_id", "own").agg(F.first("text").alias("text"))
    got = placed.join(texts, ["doc_id", "own"]) if not placed.isEmpty() else placed.join(texts.limit(0), ["doc_id", "own"])
    got = got.select("position", "doc_id", "source", "pass", "n_tokens", "text", "own", "copy")
    return got.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "pass", "own", "copy").drop("own", "copy")
