import numpy as np
import pytest
from pyspark.sql import functions as F
from verbena.llm.mixing import Mix, allocate, invert, mix, segments, tilted

DOC = "doc_id bigint, text string, source string, pass int, position string, bucket int"
TARGET = "source string, target_share double, max_repeats int, text string"


def make(spark, docs, targets):
    return spark.createDataFrame([(i, t, s, 9, "x", 9) for i, (s, t) in enumerate(docs)], DOC), spark.createDataFrame([(*t, "x") for t in targets], TARGET)


def test_shares_caps_and_positions(spark):
    docs = [("a", "uno dos tres cuatro " * 5)] * 60 + [("b", "cinco seis " * 5)] * 40 + [("c", "siete " * 5)] * 20 + [("zzz", "otro")] * 5 + [(None, "nada"), ("a", None), ("b", "")]
    d, t = make(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 3), ("none", None, None)])
    m = Mix(d, t)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["gone"].actual_share == 0 and shares["none"].n_docs == 0
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert shares[s].actual_share == pytest.approx(w, abs=0.03) and shares[s].repeats <= m.targets[s][1] + 1e-9
    got = mix(d, t).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    assert {r.source for r in got} == {"a", "b", "c"} and all(r.text for r in got)
    uses = {}
    for r in got:
        uses[(r.doc_id, r["pass"])] = uses.get((r.doc_id, r["pass"]), 0) + 1
    assert max(uses.values()) == 1


def test_allocation():
    have, targets = {"a": (100.0, 10), "b": (1000.0, 10)}, {"a": (0.5, 2), "b": (0.5, 1)}
    assert allocate(have, targets) == {"a": 200.0, "b": 200.0}
    assert allocate(have, targets, 1000) == {"a": 200.0, "b": 800.0}
    assert allocate(have, targets, 5000) == {"a": 200.0, "b": 1000.0}
    assert allocate({}, targets) == {} and allocate(have, {}) == {}


def test_curriculum_integrates_and_inverts(spark):
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    knots = tilted(shares, {"a": 5, "b": 50, "c": 9})
    for k in (0, 1):
        assert sum(v[k][1] for v in knots.values()) == pytest.approx(1)
    need = {s: w * 1000 for s, w in shares.items()}
    parts = segments({**knots, "b": [(0.0, 0.0), (0.5, 1.0), (1.0, 0.0)]}, need)
    for s, n in need.items():
        assert max(p[2] for p in parts if p[0] == s) == pytest.approx(n)
    df = spark.createDataFrame(parts, "source string, `from` double, `to` double, t0 double, t1 double, rate double, slope double")
    got = df.select("*", invert((F.col("from") + F.col("to")) / 2).alias("t")).collect()
    for r in got:
        x = r.t - r.t0
        assert r["from"] + r.rate * x + r.slope * x * x / 2 == pytest.approx((r["from"] + r["to"]) / 2)
    assert np.isclose(next(r.t for r in got if r.source == "b" and r.t0 == 0.5), 0.5 + 0.5 * (1 - np.sqrt(0.5)))


def test_schedule_and_empty(spark):
    d, t = make(spark, [("a", "uno dos tres")] * 30 + [("b", "uno dos tres")] * 30, [("a", 0.5, 1), ("b", 0.5, 1)])
    late = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 1.0), ("a", 0.50001, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 0.5, 0.0), ("b", 0.50001, 1.0), ("b", 1.0, 1.0)], "source string, t double, weight double")
    got = Mix(d, t, schedule=late).positions().collect()
    assert len(got) == 60 and all((r.position < 0.5) == (r.source == "a") for r in got)
    e = d.limit(0)
    assert mix(e, t).count() == 0 and mix(d, t.limit(0)).count() == 0 and Mix(e, t).shares().count() == 2


def test_repeated_ids_are_documents_of_their_own(spark):
    d = spark.createDataFrame([(1, "uno dos", "a", 0, "x", 0), (1, "tres cuatro", "a", 0, "x", 0), (2, "cinco seis", "a", 0, "x", 0), (2, "cinco seis", "a", 0, "y", 1), (2, "cinco seis", "b", 0, "y", 1)], DOC)
    t = spark.createDataFrame([("a", 1.0, 1, "x")], TARGET)
    got = mix(d, t).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "tres cuatro"), (1, "uno dos"), (2, "cinco seis"), (2, "cinco seis")]
    assert Mix(d, t).shares().first().repeats == pytest.approx(1)
