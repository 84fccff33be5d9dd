import numpy as np
import pytest
from verbena.llm.consensus import PRIOR, Consensus, Messages, alpha

SCHEMA = "item bigint, annotator string, label int, who int, e string"


def crowd(n_items=300, seed=0):
    """Labels of careful, constant, reversing and guessing annotators."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 4, n_items)
    kinds = ["good"] * 4 + ["constant"] * 2 + ["reverse", "guess"]
    rows = []
    for a, kind in enumerate(kinds):
        for i in np.flatnonzero(rng.random(n_items) < 0.7):
            t = truth[i]
            v = {"good": t if rng.random() < 0.85 else min(3, t + 1), "constant": 2, "reverse": 3 - t, "guess": rng.integers(0, 4)}[kind]
            rows.append((int(i), f"{kind} {a}", int(v), 0, "x"))
    return truth, rows


def labels(c):
    return {r.item: r.label for r in c.consensus().collect()}


@pytest.mark.parametrize("few", [True, False])
def test_better_than_votes_on_held_out_truth(spark, few):
    truth, data = crowd()
    c = Consensus(spark.createDataFrame(data, SCHEMA), broadcast_rows=1000 if few else 2)
    got = labels(c)
    votes = {}
    for i, _, v, *_ in data:
        votes.setdefault(i, []).append(v)
    vote = {i: max(set(v), key=lambda x: (v.count(x), -x)) for i, v in votes.items()}
    right = lambda d: np.mean([d[i] == truth[i] for i in got])
    assert right(got) > 0.9 and right(got) > right(vote) + 0.05
    r = {x.annotator: x for x in c.annotators().collect()}
    assert r["good 0"].reliability > 0.75 and r["reverse 6"].reliability < 0.2
    assert r["reverse 6"].n_labels == sum(a == "reverse 6" for _, a, *_ in data)


def test_both_ways_agree(spark):
    _, data = crowd(80, 3)
    df = spark.createDataFrame(data, SCHEMA)
    a, b = (Consensus(df, broadcast_rows=n).consensus().toPandas().sort_values("item").reset_index(drop=True) for n in (100, 1))
    assert (a.label == b.label).all() and (a.n_labels == b.n_labels).all() and np.allclose(a.confidence, b.confidence, atol=1e-3) and np.allclose(a.agreement, b.agreement)


def test_both_ways_stop_by_the_same_rule(spark):
    _, data = crowd(120, 5)
    df = spark.createDataFrame(data, SCHEMA)
    a, b = Consensus(df), Consensus(df, broadcast_rows=1)
    assert a.converged and b.converged and abs(a.rounds - b.rounds) <= 1
    x, y = (sorted((r.annotator, r.n_labels, round(r.reliability, 3), round(r.bias, 3)) for r in c.annotators().collect()) for c in (a, b))
    assert [r[:2] for r in x] == [r[:2] for r in y] and np.allclose([r[2:] for r in x], [r[2:] for r in y], atol=2e-3)


def test_messages_leave_out_their_own_edge():
    """An annotator's message to an item is what its labels on the other items alone would say."""
    rng = np.random.default_rng(1)
    starts, who, label = np.arange(0, 30, 3), np.tile(np.arange(3), 10), rng.integers(0, 4, 30)
    e = rng.dirichlet(np.ones(4), 30)
    def counted(edges):
        c = np.zeros((3, 4, 5))
        for i in edges:
            c[who[i], label[i]] += [*e[i], 1]
        return c
    got = Messages(starts, who, label, 4).of_annotators(e, counted(range(30)))
    for i in range(30):
        c = counted(set(range(30)) - {i})[who[i]]
        for j in range(4):
            right = float(label[i] == j)
            top, bottom = c[label[i], j] + PRIOR * (1 + 4 * right), c[:, j].sum() + PRIOR * 8
            rest, all_ = c[label[i], 4] - c[label[i], j] + PRIOR * (3 + 4 * (1 - right)), c[:, 4].sum() - c[:, j].sum() + PRIOR * 24
            assert got[i, j] == pytest.approx(np.log(top / bottom) - np.log(rest / all_))


def test_rounds_that_do_not_end_are_told(spark, monkeypatch):
    from verbena.llm import consensus

    monkeypatch.setattr(consensus, "ROUNDS", 2)
    with pytest.warns(UserWarning, match="2 rounds"):
        c = Consensus(spark.createDataFrame(crowd(50, 2)[1], SCHEMA))
    assert not c.converged


def test_nulls_ties_single_and_empty(spark):
    data = [(1, "a", 3, 0, ""), (2, "a", None, 0, ""), (None, "a", 1, 0, ""), (3, None, 1, 0, ""), (4, "b", 7, 0, ""), (4, "b", -1, 0, "")]
    c = Consensus(spark.createDataFrame(data, SCHEMA))
    assert labels(c) == {1: 3} and c.consensus().first().agreement == 1.0
    c = Consensus(spark.createDataFrame([], SCHEMA))
    assert c.consensus().count() == 0 and c.annotators().count() == 0
    tie = Consensus(spark.createDataFrame([(1, "a", 2, 0, ""), (1, "b", 1, 0, "")], SCHEMA)).consensus().first()
    assert tie.label == 1 and tie.n_labels == 2 and tie.n_distinct == 2


def test_alpha(spark):
    edges = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 0), (2, "b", 0), (3, "a", 2), (3, "b", 3), (4, "a", 1)], "item bigint, annotator string, label int")
    r = alpha(edges).first()
    assert r.n_items == 3 and r.n_labels == 6
    assert r.alpha_nominal == pytest.approx(1 - 5 * 2 / (36 - 10))
