"""References to records that do not exist: pending-orphan state kept incrementally.

References, parents and deletions arrive in batches; no batch knows what a later one brings. The state is
  lives    (ref_field, key, parent_id, valid_from, valid_to)  every parent record as far as it is known
  index    (ref_field, key, first, last)  the span in which a key holds, one row per key
  log      references with a fault and every later verdict on them, append-only; the last verdict counts
  settled  references that held when they came, kept by batch in the order of their times
Each batch (1) merges arriving parents and deletions into lives and index, (2) lets new references probe
the index, (3) judges anew the logged references of keys whose span changed: arriving parents resolve
missing, late and deleted ones, (4) reopens settled references of keys whose span became shorter, reading
only batches and row groups with times from the first new end on. The result does not depend on how the
arrivals were cut into batches. With a ``folder`` the state is written there after every batch and
``OrphanTracker.resume`` goes on from it.

A key met by very many references costs one probe where the index is small enough to broadcast (counted);
beyond that a batch is first reduced to one row per key, and only rows of suspect keys are judged one by
one, their hot keys salted.

Defined results: a null key is no reference; a reference without a time can only be ``missing``;
repeated rows count once; several parents of one key act as one, valid from the first to the last
(no end if any has none); a parent without a beginning holds from ever; a deletion of a parent that has not
arrived waits for it; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical_key, micros_of_ntz, micros_of_text
from ..runtime import BROADCAST_ROWS, checked_join, discard, materialise, parts, written

REFERENCE = "child_table string, ref_field string, row_id bigint, key string, ref_time bigint, arrived bigint"
LIFE = "ref_field string, key string, parent_id bigint, valid_from bigint, valid_to bigint"
SPAN = "ref_field string, key string, first bigint, last bigint, old_first bigint, old_last bigint, changed boolean"
LOGGED = "child_table string, ref_field string, row_id bigint, key string, ref_time bigint, fault string, step int"
BATCH = LOGGED + ", settled boolean"
FOREVER = (1 << 63) - 1
#: Tables the log may consist of before it is rewritten as one.
COMPACT = 16
_ID = ["child_table", "ref_field", "row_id", "key", "ref_time"]


@dataclass(frozen=True)
class Child:
    """A table with references. ``fields``: its columns that refer to a parent."""

    name: str
    rows: DataFrame
    row_id: str
    ref_time: str
    arrived: str
    fields: tuple[str, ...]


def _clock(df: DataFrame, name: str) -> Column:
    return micros_of_text(name) if dict(df.dtypes)[name] == "string" else micros_of_ntz(name)


def references(child: Child) -> DataFrame:
    """One row per non-null reference, in one scan of the child."""
    pairs = F.array(*(F.struct(F.lit(f).alias("ref_field"), canonical_key(f).alias("key")) for f in child.fields))
    rows = child.rows.select(
        F.lit(child.name).alias("child_table"), F.col(child.row_id).cast("bigint").alias("row_id"), _clock(child.rows, child.ref_time).alias("ref_time"), _clock(child.rows, child.arrived).alias("arrived"), F.explode(pairs).alias("p")
    )
    return rows.filter("p.key is not null").select("child_table", "p.ref_field", "row_id", "p.key", "ref_time", F.coalesce("arrived", "ref_time", F.lit(FOREVER)).alias("arrived"))


def parents(rows: DataFrame, ref_field: str, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """One row per parent record; records are told apart by their key and times."""
    return rows.filter(F.col(key).isNotNull()).select(
        F.lit(ref_field).alias("ref_field"), canonical_key(key).alias("key"), F.coalesce(_clock(rows, valid_from), F.lit(-FOREVER)).alias("valid_from"), F.coalesce(_clock(rows, valid_to), F.lit(FOREVER)).alias("valid_to")
    ).withColumn("parent_id", F.xxhash64("ref_field", "key", "valid_from", "valid_to"))


_FAULT = "case when first is null then 'missing' when ref_time < first then 'late' when ref_time >= last then 'deleted' else 'none' end"


class OrphanTracker:
    def __init__(self, session, label: str = "orphans", folder: str | None = None):
        self.session, self.label, self.folder = session, label, folder
        self.step, self.n_keys, self.lives_at, self.index_at = 0, 0, None, None
        self.log_at: list[tuple[str, str]] = []  # path, kind: batch or log
        self.settled_at: list[str] = []
        self.tables: dict[str, DataFrame] = {}

    def _write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> str:
        got = materialise(df, f"{self.label}-{name}", partition_by, self.folder)
        self.tables[got.written_at] = got
        return got.written_at

    def _table(self, path: str | None, schema: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        if path is None:
            return self.session.createDataFrame([], schema)
        if path not in self.tables:
            self.tables[path] = written(self.session, path, T.StructType.fromDDL(schema), partition_by)
        return self.tables[path]

    @property
    def index(self) -> DataFrame:
        return self._table(self.index_at, SPAN)

    def _save(self) -> None:
        """Writes what is needed to go on; the manifest comes last, so a lost driver leaves the state before the batch."""
        state = {"step": self.step, "n_keys": self.n_keys, "lives": self.lives_at, "index": self.index_at, "log": self.log_at, "settled": self.settled_at}
        self.session.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.step}")

    @classmethod
    def resume(cls, session, folder: str, label: str = "orphans") -> OrphanTracker:
        got = max((json.loads(r.value) for r in session.read.text(f"{folder}/manifest-*").collect()), key=lambda s: s["step"])  # one small line per batch
        t = cls(session, label, folder)
        t.step, t.n_keys, t.lives_at, t.index_at = got["step"], got["n_keys"], got["lives"], got["index"]
        t.log_at, t.settled_at = [tuple(x) for x in got["log"]], got["settled"]
        return t

    def _judge(self, refs: DataFrame) -> DataFrame:
        """refs with ``fault``: missing, late, deleted or none."""
        spans = self.index.select("ref_field", "key", "first", "last")
        if self.n_keys <= BROADCAST_ROWS:  # counted as the index was written
            met = refs.join(F.broadcast(spans), ["ref_field", "key"], "left")
            return met.select(*_ID, F.expr(_FAULT).alias("fault"))
        keys = refs.groupBy("ref_field", "key").agg(F.min("ref_time").alias("from"), F.max("ref_time").alias("to"))
        suspect = keys.join(spans, ["ref_field", "key"], "left").filter("first is null or `from` < first or to >= last")
        suspect = materialise(suspect.select("ref_field", "key", "first", "last", F.lit(True).alias("suspect")), f"{self.label}-suspects")
        met = checked_join(refs, suspect, ["ref_field", "key"], "left", salt_on=["row_id"])
        return met.select(*_ID, F.when(F.col("suspect"), F.expr(_FAULT)).otherwise("none").alias("fault"))

    def verdicts(self) -> DataFrame:
        """The last verdict on every logged reference, "none" among them."""
        parts = [self._table(p, BATCH, ("settled",)).filter("not settled").drop("settled") if kind == "batch" else self._table(p, LOGGED) for p, kind in self.log_at]
        log = reduce(DataFrame.unionByName, parts, self.session.createDataFrame([], LOGGED))
        return log.groupBy(*_ID).agg(F.max_by("fault", "step").alias("fault"))

    def _learn(self, arrivals: DataFrame, deletions: DataFrame) -> tuple[int, int | None]:
        """Merges parents into the state; how many keys changed their span, and the first end of one that became shorter."""
        here = arrivals.select("ref_field", "key", "parent_id", "valid_from", F.lit(FOREVER).alias("valid_to"))
        gone = deletions.select("ref_field", "key", "parent_id", F.lit(None).cast("bigint").alias("valid_from"), "valid_to")
        merged = self._table(self.lives_at, LIFE).unionByName(here).unionByName(gone).groupBy("ref_field", "key", "parent_id").agg(F.min("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"))
        self.lives_at = self._write(merged, "lives")
        spans = self._table(self.lives_at, LIFE).filter("valid_from is not null").groupBy("ref_field", "key").agg(F.min("valid_from").alias("first"), F.max("valid_to").alias("last"))
        old = self.index.select("ref_field", "key", F.col("first").alias("old_first"), F.col("last").alias("old_last"))
        spans = spans.join(old, ["ref_field", "key"], "left").withColumn("changed", ~(F.col("first").eqNullSafe(F.col("old_first")) & F.col("last").eqNullSafe(F.col("old_last"))))
        shorter = F.when(F.col("last") < F.col("old_last"), F.col("last"))
        self.index_at = self._write(spans.select(*T.StructType.fromDDL(SPAN).names), "index")
        seen = self.index.agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.min(shorter).alias("since")).first()
        self.n_keys = seen.n
        return seen.changed, seen.since

    def advance(self, refs: DataFrame, arrivals: DataFrame | None = None, deletions: DataFrame | None = None) -> None:
        """One batch. ``arrivals``: (ref_field, key, parent_id, valid_from) that became known in it; ``deletions``: (ref_field, key, parent_id, valid_to) of records withdrawn in it."""
        before, changed, since = [self.lives_at, self.index_at], 0, None
        if arrivals is not None or deletions is not None:
            none = self.session.createDataFrame([], LIFE)
            changed, since = self._learn(none if arrivals is None else arrivals, none if deletions is None else deletions)
        delta = []
        if changed:
            touched = self.index.filter("changed").select("ref_field", "key", "first", "last", "old_last")
            if self.log_at:
                again = checked_join(self.verdicts().withColumnRenamed("fault", "was"), touched, ["ref_field", "key"], salt_on=["row_id"])
                delta.append(again.withColumn("fault", F.expr(_FAULT)).filter("fault <> was").select(*_ID, "fault"))
            for path in self.settled_at if since is not None else []:  # row groups of earlier times are passed over by their bounds
                old = self._table(path, BATCH, ("settled",)).filter(F.col("settled") & (F.col("ref_time") >= since)).select(*_ID)
                rows = checked_join(old, touched.filter("last < old_last"), ["ref_field", "key"], salt_on=["row_id"])
                delta.append(rows.filter("ref_time >= last and ref_time < old_last").select(*_ID, F.lit("deleted").alias("fault")))
        step = F.lit(self.step).alias("step")
        if delta:
            self.log_at.append((self._write(reduce(DataFrame.unionByName, delta).select(*_ID, "fault", step), "delta"), "log"))
        verdict = self._judge(refs.select(*_ID)).withColumn("settled", F.col("fault") == "none")
        batch = self._write(verdict.select(*_ID, "fault", step, "settled").sortWithinPartitions("settled", "ref_time"), "batch", ("settled",))
        self.log_at.append((batch, "batch"))
        self.settled_at.append(batch)
        self.step += 1
        if len(self.log_at) > COMPACT:
            self.log_at = [(self._write(self.verdicts().select(*_ID, "fault", F.lit(self.step - 1).alias("step")), "log"), "log")]
        if self.folder:
            self._save()
        else:  # lives and index as they were before are read by nothing any more
            discard(*(self.tables.pop(p) for p in before if p and p not in (self.lives_at, self.index_at)))

    def found(self) -> DataFrame:
        return self.verdicts().filter("fault <> 'none'")

    def snapshot(self, at: int) -> DataFrame:
        """Counts as of the time ``at`` per table, field and fault."""
        return self.found().groupBy("child_table", "ref_field", "fault").agg(F.count("*").alias("n_refs")).select(F.expr(f"timestampadd(MICROSECOND, {at}, timestamp_ntz'1970-01-01 00:00:00')").alias("as_of"), "child_table", "ref_field", "fault", "n_refs")

def track(children: list[Child], parent_rows: DataFrame, period_days: int = 183, snapshots: bool = False, folder: str | None = None) -> tuple[OrphanTracker, DataFrame | None]:
    """Replay the arrivals of all tables in batches and return the tracker (and the snapshots after each batch).

    A batch is a period of ``period_days`` in which references arrived, with the parent records and deletions since the batch
    before; the last one also holds references of unknown arrival and what comes after. Its snapshot holds everything.
    Without snapshots, periods of less than a 64th of all references are put together with the next.
    """
    refs = reduce(DataFrame.unionByName, map(references, children))
    session = refs.sparkSession
    born = materialise(parent_rows.distinct(), "orphan-parents")
    width = period_days * 86_400_000_000
    batch = F.when(F.col("arrived") == FOREVER, None).otherwise(F.floor(F.col("arrived") / width)).cast("int")
    refs = materialise(refs.withColumn("batch", batch), "orphan-refs", ["batch"])
    sizes = {k.partition("=")[2]: n for k, n in parts(session, refs.written_at).items()}  # one per period
    known, least = sorted(int(k) for k in sizes if k.lstrip("-").isdigit()), 0 if snapshots else sum(sizes.values()) / 64
    steps, size = [], 0
    for k in known:
        size += sizes[str(k)]
        if size >= least or k == known[-1]:
            steps.append(k)
            size = 0
    steps = steps or [0]
    tracker, shots, lo = OrphanTracker(session, folder=folder), None, None
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        hi = FOREVER if last else (step + 1) * width - 1
        since = lambda c: (F.lit(True) if lo is None else c > lo) & (c <= hi)  # noqa: B023, E731
        mine = refs.filter((F.lit(True) if lo is None else F.col("batch") > steps[k - 1]) & (F.col("batch") <= step))
        if last:
            mine = mine.unionByName(refs.filter("batch is null"))
        arrivals = born.filter(since(F.col("valid_from")))
        # The end becomes known when it comes, but not before the record itself.
        ended = born.filter(F.col("valid_to") != FOREVER).filter(since(F.greatest("valid_to", "valid_from")))
        tracker.advance(mine, arrivals, ended)
        lo = hi
        if snapshots:
            shot = materialise(tracker.snapshot((step + 1) * width), "orphan-shot")
            shots = shot if shots is None else shots.unionByName(shot)
    return tracker, shots


def orphan_rows(tracker: OrphanTracker) -> DataFrame:
    return tracker.found().select("child_table", "ref_field", "row_id", "fault").distinct()


def orphan_report(tracker: OrphanTracker) -> DataFrame:
    """Orphans per table, field, fault and month of the reference; month is null where the reference has no time."""
    month = F.substring(F.expr("cast(timestampadd(MICROSECOND, ref_time, timestamp_ntz'1970-01-01 00:00:00') as string)"), 1, 7)
    rows = tracker.found().select("child_table", "ref_field", "row_id", "fault", month.alias("month")).distinct()
    return rows.groupBy("child_table", "ref_field", "month", "fault").agg(F.count("*").alias("n_refs"))
