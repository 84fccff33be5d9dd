"""Consensus of several annotators' labels by message passing on the item-annotator graph.

Every label is an edge. For each class, one against the rest, the annotator sends along each edge the log ratio
of giving this label when the class holds and when it does not, as its labels on all other items show; the item adds
up its messages to log odds per class, reconciles the classes (one of them holds), and sends back how likely
each class is by the item's other labels. Both messages leave out what came along the edge itself. Rounds go on
until no annotator's counts move; then the class with the highest log odds wins. (Problems that are never
reconciled are no alternative: the rest of a class is a mixture, and a marked share of the labels comes out wrong.) Annotators who always give one label, guess, or turn the scale
around lose or change their weight by themselves.

A round is one scan of the items, which writes the messages anew together with one small row of counts per
task, annotator and label. While the annotators are few (counted first) their counts are broadcast and an
item's labels, at most one per annotator, lie in one row; beyond that edges and counts are joined (hot annotators
salted) and summed in shuffles. Both ways stop by the same rule, and ``converged`` tells whether it was met within ROUNDS.

Defined results: null labels, items and annotators, and labels outside the classes, are no edges; one
label per item and annotator (the callers choose); an item with one label gets that label; ties go to
the smaller label; no edges give an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, at_most, checked_join, discard, materialise

#: Pseudo-counts: of every label, and besides of the right one.
PRIOR = 0.25
#: Most rounds, and the change of a count, in labels of a mean annotator, at which they end.
ROUNDS, TOLERANCE = 60, 1e-4


def _log_ratio(in_class, of_class, label_all, all_, right, k: int, log=np.log):
    """log P(label | class) / P(label | rest) from counts without the receiving item: of the label in the class, of the class, of the label, of all.

    ``right``: 1 where the label is the class. Works on arrays and on columns.
    """
    top, bottom = in_class + PRIOR * (1 + 4 * right), of_class + PRIOR * (k + 4)
    rest_top, rest_bottom = label_all - in_class + PRIOR * (k - 1 + 4 * (1 - right)), all_ - of_class + PRIOR * (k + 4) * (k - 1)
    return log(top / bottom) - log(rest_top / rest_bottom)


def _reconciled(odds: np.ndarray) -> np.ndarray:
    """Chances of the classes, of which one holds, by their log odds against the rest."""
    e = np.exp(odds - odds.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Messages:
    """One round over items whose edges lie one after the other."""

    def __init__(self, starts: np.ndarray, who: np.ndarray, label: np.ndarray, k: int):
        self.starts, self.who, self.label, self.k = starts, who, label, k
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(who))))

    def votes(self) -> np.ndarray:
        """The first messages of the items: shares of the other votes."""
        own = np.eye(self.k)[self.label]
        others = np.add.reduceat(own, self.starts, axis=0)[self.of] - own + 0.01
        return others / others.sum(1, keepdims=True)

    def of_annotators(self, e: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts: (annotator, label, classes and in the last place the number of labels)."""
        c, n = counts[..., :-1], counts[..., -1]
        return _log_ratio(c[self.who, self.label] - e, c.sum(1)[self.who] - e, n[self.who, self.label][:, None] - 1, n.sum(1)[self.who][:, None] - 1, np.eye(self.k)[self.label], self.k)

    def odds(self, m: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return np.log(prior / (1 - prior)) + np.add.reduceat(m, self.starts, axis=0)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, label = batch.column("who"), batch.column("label")
    offsets = np.asarray(who.offsets)
    return (offsets[:-1] - offsets[0]).astype(int), who.flatten().to_numpy(zero_copy_only=False), label.flatten().to_numpy(zero_copy_only=False)


_STATE = pa.schema([("part", pa.string()), ("item", pa.int64()), ("who", pa.list_(pa.int32())), ("label", pa.list_(pa.int32())), ("e", pa.list_(pa.float32())), ("a", pa.int32()), ("v", pa.int32()), ("c", pa.list_(pa.float64()))])
_STATE_DDL = "part string, item bigint, who array<int>, label array<int>, e array<float>, a int, v int, c array<double>"


class Consensus:
    """edges: item bigint, annotator string, label int (0 .. classes - 1), one per item and annotator."""

    def __init__(self, edges: DataFrame, classes: int = 4, broadcast_rows: int = BROADCAST_ROWS):
        self.k = classes
        self.edges = edges.select("item", "annotator", F.col("label").cast("int").alias("label")).filter(f"item is not null and annotator is not null and label between 0 and {classes - 1}")
        names = materialise(self.edges.select("annotator").distinct(), "consensus-annotators")
        self.few = at_most(names, broadcast_rows)
        self.broadcast_rows, self.rounds, self.converged, self.prior = broadcast_rows, 0, False, np.full(classes, 1 / classes)
        if self.few:
            self.names = sorted(r.annotator for r in names.collect())
            code = names.sparkSession.createDataFrame([(a, i) for i, a in enumerate(self.names)], "annotator string, who int")
            pair = F.struct("who", "label")
            coded = self.edges.join(F.broadcast(code), "annotator").groupBy("item").agg(F.sort_array(F.collect_list(pair)).alias("e"))
            self.items = materialise(coded.select("item", F.col("e.who").alias("who"), F.col("e.label").alias("label"), F.lit(None).cast("array<float>").alias("e")), "consensus-items")
            self._iterate()
        else:
            self.edges = materialise(self.edges, "consensus-edges")
            self._iterate_shuffled()
        if self.rounds and not self.converged:
            warnings.warn(f"the messages still moved after {self.rounds} rounds", stacklevel=2)

    def _still(self, moved: float, labels: float, annotators: float) -> bool:
        return moved <= TOLERANCE * max(1.0, labels / max(1.0, annotators))

    # Few annotators: their counts are an array on the driver, one row per annotator and label.
    def _round(self, counts: np.ndarray | None) -> np.ndarray:
        k, n = self.k, len(self.names)
        shared = self.items.sparkSession.sparkContext.broadcast((counts, self.prior))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, prior = shared.value
            new, mass, seen = np.zeros((n, k, k + 1)), np.zeros(k + 1), 0  # annotator, label, class
            for b in batches:
                if not b.num_rows:
                    continue
                starts, who, label = _lists(b)
                g = Messages(starts, who, label, k)
                if counts is None:
                    e = g.votes()
                    belief = np.add.reduceat(e, starts, axis=0) / np.diff(np.append(starts, len(who)))[:, None]
                else:
                    m = g.of_annotators(b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float), counts)
                    odds = g.odds(m, prior)
                    e, belief = _reconciled(odds[g.of] - m), _reconciled(odds)
                e = e.astype(np.float32)
                np.add.at(new, (who, label), np.concatenate([e, np.ones((len(e), 1))], axis=1))
                mass[:-1] += belief.sum(0)
                mass[-1] += len(belief)
                seen += 1
                ends = np.append(starts, len(who)) * k
                nothing = pa.nulls(b.num_rows, pa.int32())
                columns = [pa.array(["items"] * b.num_rows), b.column("item"), b.column("who"), b.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(e.ravel())), nothing, nothing, pa.nulls(b.num_rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _STATE)], schema=_STATE)
            if seen:
                a, v = np.nonzero(new[..., -1])
                rows = [{"part": "counts", "a": int(x), "v": int(y), "c": new[x, y].tolist()} for x, y in zip(a, v)] + [{"part": "counts", "a": -1, "v": 0, "c": mass.tolist()}]
                yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

        got = materialise(self.items.mapInArrow(run, _STATE_DDL), "consensus-round", ["part"])
        shared.destroy()
        discard(self.items)
        self.items = got.filter("part = 'items'").select("item", "who", "label", "e")
        self.items.written_at = got.written_at
        new = np.zeros((n, k, k + 1))
        mass = np.zeros(k + 1)
        sums = got.filter("part = 'counts'").groupBy("a", "v").agg(*(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(k + 1)))
        for a, v, *c in sums.collect():  # annotators x labels
            if a < 0:
                mass = np.array(c)
            else:
                new[a, v] = c
        self.prior = np.clip(mass[:-1] / max(1.0, mass[-1]), 1e-6, 1 - 1e-6)
        return new

    def _iterate(self) -> None:
        self.counts = None
        while self.names and self.rounds < ROUNDS and not self.converged:
            new = self._round(self.counts)
            self.rounds += 1
            self.converged = self.counts is not None and self._still(np.abs(new - self.counts).max(), new[..., -1].sum(), len(self.names))
            self.counts = new

    def consensus(self) -> DataFrame:
        """(item, label, confidence, n_labels, n_distinct, agreement): agreement is the share of labels equal to the consensus."""
        if not self.few:
            return self._consensus_shuffled()
        k = self.k
        shared = self.items.sparkSession.sparkContext.broadcast((self.counts, self.prior))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, prior = shared.value
            for b in batches:
                if b.num_rows:
                    starts, who, label = _lists(b)
                    g = Messages(starts, who, label, k)
                    odds = g.odds(g.of_annotators(b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float), counts), prior)
                    best = (odds >= odds.max(1, keepdims=True) - 1e-6).argmax(1)
                    chance = _reconciled(odds).max(1)
                    votes = np.zeros((len(odds), k), int)
                    np.add.at(votes, (g.of, label), 1)
                    n = votes.sum(1)
                    single = n == 1
                    best[single] = votes[single].argmax(1)
                    out = {"item": b.column("item"), "label": pa.array(best, pa.int32()), "confidence": pa.array(chance), "n_labels": pa.array(n, pa.int32()), "n_distinct": pa.array((votes > 0).sum(1), pa.int32()), "agreement": pa.array(votes[np.arange(len(odds)), best] / n)}
                    yield pa.RecordBatch.from_pydict(out)

        return self.items.mapInArrow(run, "item bigint, label int, confidence double, n_labels int, n_distinct int, agreement double")

    def annotators(self) -> DataFrame:
        """(annotator, n_labels, reliability, bias): the expected share of right labels and the mean of label minus class."""
        k, schema = self.k, "annotator string, n_labels double, reliability double, bias double"
        if self.few:
            rows, step = [], np.arange(k)
            for a, c in zip(self.names, self.counts if self.counts is not None else []):
                share = c[:, :-1] / np.maximum(c[:, :-1].sum(1, keepdims=True), 1e-9) * c[:, -1:]  # of each label over the classes
                n = c[:, -1].sum()
                rows.append((a, float(n), float(np.trace(share) / n), float(((step[:, None] - step[None, :]) * share).sum() / n)))
            return self.items.sparkSession.createDataFrame(rows, schema)
        total = sum(F.col(f"c{j}") for j in range(k))
        share = [F.col(f"c{j}") / F.greatest(total, F.lit(1e-9)) * F.col("n") for j in range(k)]
        right = sum(F.when(F.col("label") == j, x).otherwise(0.0) for j, x in enumerate(share))
        bias = sum((F.col("label") - j) * x for j, x in enumerate(share))
        n = F.sum("n")
        return self.table.groupBy("annotator").agg(n.cast("double").alias("n_labels"), (F.sum(right) / n).alias("reliability"), (F.sum(bias) / n).alias("bias"))

    # Many annotators: the same messages as joins and sums.
    def _counted(self, state: DataFrame) -> DataFrame:
        """(annotator, label, c0 .., n, t0 .., all): an annotator's counts per label, and over its labels."""
        k = self.k
        per = state.groupBy("annotator", "label").agg(*(F.sum(F.col("e")[j]).alias(f"c{j}") for j in range(k)), F.count("*").alias("n"))
        whole = per.groupBy("annotator").agg(F.collect_list(F.struct("label", "n", *(f"c{j}" for j in range(k)))).alias("rows"), *(F.sum(f"c{j}").alias(f"t{j}") for j in range(k)), F.sum("n").alias("all"))  # at most k rows each
        return whole.select("annotator", F.explode("rows").alias("r"), *(f"t{j}" for j in range(k)), "all").select("annotator", "r.*", *(f"t{j}" for j in range(k)), "all")

    def _odds(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(item, o: log odds by class) and the edges with the messages m of their annotators."""
        k = self.k
        met = checked_join(state, self.table, ["annotator", "label"], max_rows=self.broadcast_rows, salt_on=["item"])
        right = lambda j: (F.col("label") == j).cast("double")
        m = F.array(*(_log_ratio(F.col(f"c{j}") - F.col("e")[j], F.col(f"t{j}") - F.col("e")[j], F.col("n") - 1, F.col("all") - 1, right(j), k, F.log) for j in range(k)))
        edges = met.select("item", "annotator", "label", m.alias("m"))
        prior = [float(np.log(p / (1 - p))) for p in self.prior]
        return edges.groupBy("item").agg(F.array(*(F.sum(F.col("m")[j]) + prior[j] for j in range(k))).alias("o")), edges

    def _iterate_shuffled(self) -> None:
        k = self.k
        def reconciled(x: list[Column]) -> list[Column]:
            e = [F.exp(v - F.greatest(*x)) for v in x]
            return [v / sum(e) for v in e]

        votes = self.edges.groupBy("item").agg(*(F.count_if(F.col("label") == j).alias(f"t{j}") for j in range(k)))
        other = [F.col(f"t{j}") - (F.col("label") == j).cast("int") + 0.01 for j in range(k)]
        self.state = materialise(self.edges.join(votes, "item").select("item", "annotator", "label", F.array(*(x / sum(other) for x in other)).alias("e")), "consensus-state")
        mass = self.state.agg(*(F.avg(F.col("e")[j]) for j in range(k))).first()
        self.table, labels = materialise(self._counted(self.state), "consensus-table"), self.edges.count()
        annotators = self.table.select("annotator").distinct().count()
        self.prior, self.rounds = np.clip(np.array([x or 0.0 for x in mass], float), 1e-6, 1 - 1e-6), 1
        while labels and self.rounds < ROUNDS and not self.converged:
            items, edges = self._odds(self.state)
            items = materialise(items, "consensus-odds")
            mass = items.agg(*(F.avg(x) for x in reconciled([F.col("o")[j] for j in range(k)]))).first()
            e = F.array(*reconciled([F.col("o")[j] - F.col("m")[j] for j in range(k)]))
            state = materialise(edges.join(items, "item").select("item", "annotator", "label", e.alias("e")), "consensus-state")
            table = materialise(self._counted(state), "consensus-table")
            both = table.alias("x").join(self.table.alias("y"), ["annotator", "label"])
            moved = both.agg(F.max(F.greatest(*(F.abs(F.col(f"x.c{j}") - F.col(f"y.c{j}")) for j in range(k))))).first()[0]
            discard(self.state, self.table, items)
            self.state, self.table, self.prior = state, table, np.clip(np.array(mass, float), 1e-6, 1 - 1e-6)
            self.rounds += 1
            self.converged = self._still(moved, labels, annotators)

    def _consensus_shuffled(self) -> DataFrame:
        k = self.k
        items, _ = self._odds(self.state)
        o = [F.col("o")[j] for j in range(k)]
        best = F.coalesce(*(F.when(x >= F.array_max("o") - 1e-6, j) for j, x in enumerate(o))).cast("int")
        votes = self.edges.groupBy("item").agg(*(F.count_if(F.col("label") == j).alias(f"v{j}") for j in range(k)))
        v = [F.col(f"v{j}") for j in range(k)]
        got = items.join(votes, "item").withColumn("n", sum(v))
        got = got.withColumn("best", F.when(F.col("n") == 1, sum(x * j for j, x in enumerate(v)).cast("int")).otherwise(best))
        mine = sum(F.when(F.col("best") == j, x).otherwise(0) for j, x in enumerate(v))
        chance: Column = 1 / sum(F.exp(x - F.array_max("o")) for x in o)
        return got.select("item", F.col("best").alias("label"), chance.alias("confidence"), F.col("n").cast("int").alias("n_labels"), sum((x > 0).cast("int") for x in v).alias("n_distinct"), (mine / F.col("n")).alias("agreement"))


def alpha(edges: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha of the labels, nominal and interval, over items with two labels or more."""
    per = edges.groupBy("item").agg(F.count("*").alias("n"), F.sum("label").alias("s"), F.sum(F.col("label") * F.col("label")).alias("q"))
    per = per.filter("n >= 2")
    same = edges.groupBy("item", "label").agg(F.count("*").alias("c")).groupBy("item").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    per = per.join(same, "item")
    within = per.agg(F.count("*").alias("n_items"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum((F.col("n") * F.col("n") - F.col("cc")) / (F.col("n") - 1)).alias("d1"), F.sum((2 * F.col("n") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("d2"))
    used = edges.join(per.select("item"), "item", "left_semi").groupBy("label").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    both = within.crossJoin(used)  # one row each
    n = F.col("n")
    return both.select("n_items", n.alias("n_labels"), (1 - (n - 1) * F.col("d1") / (n * n - F.col("mm"))).alias("alpha_nominal"), (1 - (n - 1) * F.col("d2") / (2 * n * F.col("q") - 2 * F.col("s") * F.col("s"))).alias("alpha_interval"))
