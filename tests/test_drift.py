import itertools
import json

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from verbena.operators.drift import KEPT, Drift, _covered, best_matching, name_likeness

SCHEMA = "record_id bigint, producer string, feed string, file_name string, file_seq int, payload string, field_path int, value string, kinds string"


def drift(spark, files, feed="f", nested=None, producer="p"):
    data, i = [], 0
    for seq, payloads in files.items():
        for p in payloads:
            i += 1
            data.append((i, producer, feed, f"{producer}/{feed}_{seq}", seq, p if p is None or isinstance(p, str) else json.dumps(p), 1, "x", "y"))
    return Drift(spark.createDataFrame(data, SCHEMA), nested)


def changes(d):
    return rows(d.changes().select("file_name", "field_path", "change_kind"))


def test_kinds_of_change(spark):
    d = drift(spark, {1: [{"a": 1, "tier": "T0", "Perfil": "x y"}, {"a": None, "tier": "T1"}], 2: [{"a": "1", "nivel": "T1", "perfil": "x y"}, {"a": "N/A", "nivel": "T0"}], 3: [{"a": None, "nivel": "T0", "perfil": "x y", "n": [1]}], 4: [{"nivel": "T0", "perfil": {"v": 1}, "n": [2]}]})
    assert changes(d) == sorted([("type_changed", "a", "p/f_2"), ("renamed", "nivel", "p/f_2"), ("renamed", "perfil", "p/f_2"), ("added", "n", "p/f_3"), ("removed", "a", "p/f_4"), ("type_changed", "perfil", "p/f_4")], key=repr)


def test_names_side_by_side_are_no_rename(spark):
    d = drift(spark, {1: [{"begun": "2025-01-01"}], 2: [{"ended": "2025-01-01"}], 3: [{"begun": "2025-01-01", "ended": "2025-01-02"}]})
    assert ("renamed", "ended", "p/f_2") not in changes(d)
    d = drift(spark, {1: [{"begun": "2025-01-01"}], 2: [{"inicio": "2025-02-01"}]})
    assert changes(d) == [("renamed", "inicio", "p/f_2")]


def test_nested_members(spark):
    d = drift(spark, {1: [{"s": {"x_1": 1}, "t": {"x": 1}}], 2: [{"s": {"X_1": 1, "y": "a"}, "t": {"z": 1}}]}, "eval", {"eval": ("s",)})
    assert changes(d) == sorted([("renamed", "s.X_1", "p/eval_2"), ("added", "s.y", "p/eval_2")], key=repr)


def test_unreadable_empty_and_repeated(spark):
    d = drift(spark, {1: [None, "", "{bad", "[1]", {"a": 1}, {"a": 1}], 2: ["null"], 3: [{"a": 1}]})
    assert changes(d) == sorted([("removed", "a", "p/f_2"), ("added", "a", "p/f_3")], key=repr)
    assert Drift(spark.createDataFrame([], SCHEMA)).changes().count() == 0
    assert drift(spark, {1: [{"a": "w " * 50_000}], 2: [{"a": "w " * 50_000}]}).changes().count() == 0


def test_unified_table(spark):
    d = drift(spark, {1: [{"score": 0.5, "who": "a"}], 2: [{"Score": "0,7", "who": ["b"]}], 3: [{"Score": "N/A", "who": {"valor": "c"}}]})
    got = d.unified("f")
    name = "score" if "score" in got.columns else "Score"
    assert sorted(((r[name], r.who) for r in got.collect()), key=repr) == sorted([(0.5, "a"), (0.7, "b"), (None, "c")], key=repr)


def test_likeness_does_not_fade_in_large_feeds(spark):
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}x{i}y{k}" for k in range(i)) for i in range(3, 203)]
    d = drift(spark, {1: [{"cita": t} for t in texts], 2: [{"quote": t} for t in texts]})
    assert changes(d) == [("renamed", "quote", "p/f_2")]
    assert all(len(r.sketch) <= 2 * KEPT for r in d.profile.collect())


def test_share_of_sketches():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 1 << 40, 20_000)), np.unique(rng.integers(0, 1 << 40, 20_000))
    half = np.union1d(a[::2], b[::2])
    sketch = lambda s: s[:KEPT]
    assert _covered(sketch(a), sketch(a)) == 1 and _covered(sketch(a), sketch(b)) < 0.02
    assert _covered(sketch(a), sketch(half)) == pytest.approx(0.5, abs=0.1)
    assert _covered(a[:10], np.union1d(a[5:10], b[:20])) == 0.5


def test_unified_table_leaves_nothing_out(spark):
    d = drift(spark, {1: [{"m": ["T0"], "c": {"valor": 1, "origen": "x"}, "s": {"a": 1}}, {"m": ["T0", "T1", "T3"], "c": 2, "s": []}], 2: [{"m": "T2", "c": [{"valor": "3", "origen": ["y", "z"]}], "s": [1, {"b": 2}]}]})
    got = d.unified("f")
    assert [(r.m, r.c, r.c_origen, r.s) for r in got.orderBy("record_id").collect()] == [("T0", 1, "x", '{"a":1}'), ('["T0","T1","T3"]', 2, None, "[]"), ("T2", 3, '["y","z"]', '[1,{"b":2}]')]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_matching_is_the_best(n, m, rnd):
    w = np.array([[rnd.choice([0, rnd.random()]) for _ in range(m)] for _ in range(n)])
    a, b = (w, False) if n <= m else (w.T, True)
    best = max(sum(a[i, p[i]] for i in range(a.shape[0])) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
    got = best_matching(w)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(w[i, j] > 0 for i, j in got)
    assert sum(w[i, j] for i, j in got) == pytest.approx(best)


def test_names():
    assert name_likeness("cita_M1", "cita_m1") == 1 and name_likeness("scoreCompuesto", "score_compuesto") == 1
    assert name_likeness("n_species", "num_especies") > name_likeness("n_species", "duracion_s")
