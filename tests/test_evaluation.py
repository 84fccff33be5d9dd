"""Judges, assignments, reports and the text operators of the catalogue, against recorded cases and brute force."""

import json
import re

import numpy as np
import pytest
from conftest import MEDIUM, rows
from pyspark.sql import functions as F
from verbena.functions import text as X
from verbena.functions.numbers import half_away, half_even, whole, zero_as_missing
from verbena.operators import assignment as A
from verbena.operators import geo as G
from verbena.operators import judging as J
from verbena.operators import ml as M
from verbena.operators import relational as R
from verbena.operators import reports as P
from verbena.operators import scoring as S
from verbena.operators import stats as Q
from verbena.plans.texts import CATALOGUE_RULES
from verbena.sources import sinks


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


# Judges

def answer(m1, m2, m3, m4, m5):
    return json.dumps(dict(zip(S.METRICS, (m1, m2, m3, m4, m5))))


ITEM = "key string, tier string, perfil string, taxonomy_valid boolean, ficha string, said string"


def test_ensemble_and_failover(spark):
    a = {"q1": answer(3, "N/A", 3, "N/A", 3), "q2": "not json", "q3": None, "q4": "```json\n" + answer(0, 2, 3, 1, 3) + "\n```", "q5": answer(1, 1, 1, 1, 1)}
    b = {"q1": answer(2, "N/A", 3, "N/A", 2), "q2": answer(3, 2, 3, 2, 3), "q3": "{}", "q4": answer(3, 2, 3, None, 3), "q5": answer(3, 2, 3, 2, 3)}
    c = {q: answer(2, 2, 2, 2, 2) for q in a}
    items = spark.createDataFrame([(q, "T3" if q != "q1" else "T0", "botanico", q != "q5", "f", q) for q in a], ITEM)
    got = {r.key: r.result for r in J.judged(items, ["key"], F.col("said"), a.get, b.get, c.get).collect()}
    assert got["q3"] is None
    r = got["q1"]
    assert (r.m1_precision_geografica, r.m2_precision_altitudinal, r.score_compuesto, r.max_metric_diff, r.disagree_flag, r.judge_c_scores) == ("2.5", "N/A", 0.8889, 1.0, False, None)
    r = got["q2"]  # the first judge's answer cannot be read
    assert (r.judge_a_label, r.judge_b_label, r.score_compuesto, r.max_metric_diff) == ("B", "B", 1.0, 0.0)
    r = got["q4"]
    assert r.disagree_flag and r.needs_human_review and r.used_tiebreaker and json.loads(r.judge_c_scores)["m1_precision_geografica"] == "2"
    assert (r.m1_precision_geografica, r.m4_variable_climatica) == ("1.5", "1.0")  # the third judge is not averaged in
    assert got["q5"].score_compuesto == 0.1


def test_judges_of_the_same_family_are_replaced(spark):
    items = spark.createDataFrame([("q", "T0", "random", True, "f", "q")], ITEM)
    low, high = answer(0, "N/A", 3, "N/A", 3), answer(3, "N/A", 3, "N/A", 3)
    a, b, c = (lambda _: low), (lambda _: high), (lambda _: high)
    r = J.judged(items, ["key"], F.col("said"), a, b, c, own_a=F.lit(True)).first().result
    assert (r.judge_a_label, r.judge_b_label, r.m1_precision_geografica, r.disagree_flag) == ("C", "B", "3.0", False)
    assert J.judged(items, ["key"], F.col("said"), a, b, None, own_a=F.lit(True)).first().result.judge_a_label == "A"  # nobody to stand in


def test_client_is_asked_again(spark):
    def moody(prompt, seen=[]):  # noqa: B006
        seen.append(prompt)
        if len(seen) < 3:
            raise OSError
        return prompt.upper()

    df = spark.createDataFrame([("k", "a")], "key string, said string").coalesce(1)
    assert J.asked(df, ["key"], F.col("said"), moody).first().answer == "A"
    assert J.asked(df, ["key"], F.col("said"), moody, retries=2).first().answer is None
    assert J.asked(df, ["key"], F.lit(None).cast("string"), moody).first().answer is None


def test_loop_goes_on_from_its_log(spark):
    items = spark.createDataFrame([(k, "T0", "random", True, "f" if k != "d" else " ", k) for k in "abcd"] + [("a", "T0", "random", True, "f", "a")], ITEM)
    log = spark.createDataFrame([("a", "done", 7), ("b", "failed", None), ("z", "done", 1)], "key string, status string, result int")
    asked = []

    def evaluate(todo):
        asked.extend(r.key for r in todo.collect())
        return todo.withColumn("result", F.when(F.col("key") == "b", 5))

    got = J.evaluation_loop(items, log, ["key"], evaluate, "ficha")
    assert rows(got.select("key", "result", "status")) == sorted([("a", 7, "done"), ("b", 5, "done"), ("c", None, "failed")], key=repr)
    assert sorted(asked) == ["b", "c"]


def test_taxonomy_and_plausibility(spark):
    valid = lambda s, c: one(spark, S.taxonomy_valid(F.lit(s), F.lit(c)), a="")
    assert [valid("ACCEPTED", None), valid("SYNONYM", 80), valid("SYNONYM", 79), valid("NOT_FOUND", 99), valid(None, None)] == [True, True, False, False, True]
    score = lambda text, lows, highs: one(spark, S.elevation_plausibility(X.plain_elevations("a"), lows, highs), a=text)
    i = lambda v: F.lit(v).cast("int")
    assert [score("de 300 a 900 m", [i(500), i(None)], [i(700), i(None)]), score("de 200 a 900 m", i(500), i(700)), score("a 50 m", i(500), i(700)), score("100 m", [i(500)], [i(700)]), score("500 m", i(None), i(700))] == [2, 1, 0, 0, None]


@pytest.mark.parametrize("text,want", [("entre 300 y 700 m", [300, 700]), ("de 400 hasta 900 m", [400, 900]), ("1 200 a 1 500 m", [1200, 1500])])
def test_heights_in_words(spark, text, want):
    assert one(spark, X.elevations("a"), a=text) == want and one(spark, X.plain_elevations("a"), a=text) in (want, sorted({*want, 500}))


# Assignments

def test_questions_are_assigned_like_cards(spark):
    items = lambda n: spark.createDataFrame([(f"Sp{i}", "turista" if i % 2 else "botanico") for i in range(n)], "sp string, persona string")
    pool = {"turista": [f"t{i}" for i in range(10)], "botanico": [f"b{i}" for i in range(17)]}
    none = spark.createDataFrame([], "sp string, persona string")
    got = A.assigned_questions(items(20), none, "sp", "persona", pool).collect()
    assert len(got) == 20 and all(r.entry[0] == r.persona[0] for r in got)  # pools apart
    for p in pool:
        mine = [r.entry for r in got if r.persona == p]
        assert len(set(mine)) == len(mine)  # none twice while the pool lasts
    many = A.assigned_questions(items(60), none, "sp", "persona", pool).groupBy("persona", "entry").count().collect()
    assert {r["count"] for r in many if r.persona == "turista"} == {3}
    log = spark.createDataFrame([("Sp0", "botanico"), ("Sp1", "botanico")], "sp string, persona string")
    left = {r.sp for r in A.assigned_questions(items(8), log, "sp", "persona", pool).collect()}
    assert left == {f"Sp{i}" for i in range(8)} - {"Sp0"}  # a log entry of another persona does not count
    again = lambda seed: {r.sp: r.entry for r in A.assigned_questions(items(8), none, "sp", "persona", pool, seed).collect()}
    assert again(1) == again(1) and any(again(1) != again(s) for s in (2, 3, 4))


def test_personas_and_tiers(spark):
    items = spark.createDataFrame([(f"s{i}",) for i in range(200)], "sp string")
    log = spark.createDataFrame([("s1", "turista"), ("s2", "botanico")], "sp string, persona string")
    got = {r.sp: r.persona for r in A.personas(items, log, "sp", ["turista", "botanico"]).collect()}
    assert got["s1"] == "turista" and got["s2"] == "botanico" and 60 < sum(v == "turista" for v in got.values()) < 140
    assert {r.persona for r in A.personas(items, log, "sp", ["x"], fixed="botanico").collect()} == {"botanico"}
    q = spark.createDataFrame([("turista", "T1"), ("turista", "T3"), ("botanico", None), ("botanico", "T9")], "persona string, tier_min string")
    n = lambda **k: A.fitting(q, personas=["turista", "botanico"], **k).count()
    assert [n(), n(tier="T1"), n(tier="T3"), n(tier="T7"), n(persona="turista", tier="T1"), n(persona="botanico", tier="T1")] == [4, 3, 4, 4, 1, 2]
    with pytest.raises(ValueError):
        n(persona="nadie")
    assert A.seeded_choice("sp", []) is not None


def test_defaults_overrides_and_merges(spark):
    df = spark.createDataFrame([(" ", "b"), ("x", None)], "p string, q string")
    assert rows(A.with_defaults(df, {"p": "P", "q": "Q", "r": "R"})) == [("P", "b", "R"), ("x", "Q", "R")]
    m = spark.sql("select map('p', '  ', 'q', 'new', 'zz', 'x') m")
    assert m.select(A.overridden({"p": "P", "q": "Q"}, F.col("m")).alias("m")).first().m == {"p": "P", "q": "new"}
    s = spark.sql("select named_struct('x', 1, 'y', 2) a, named_struct('y', cast(null as int), 'z', 3) b")
    assert s.select(A.merged(F.col("a"), F.col("b"), ["x", "y"], ["y", "z"]).alias("m")).first().m.asDict() == {"x": 1, "y": None, "z": 3}


# Numbers and small relational operators

def test_rounding(spark):
    r = lambda f, v: spark.sql(f"select cast({v} as double) v").select(f("v").alias("x")).first().x
    assert [r(whole, v) for v in (0.5, 1.5, 2.5, -2.5, "null")] == [0, 2, 2, -2, None]
    assert r(lambda c: half_even(c, 2), 0.125) == 0.12 and r(lambda c: half_away(c, 2), 0.125) == 0.13 and r(half_away, 2.0005) == 2.001
    assert r(zero_as_missing, 0) is None and r(zero_as_missing, 3) == 3.0


def test_small_operators(spark):
    t = spark.createDataFrame([("a", 3), ("b", 2), ("zz", 1)], "k string, n bigint")
    names = spark.createDataFrame([("a", "X"), ("b", "X")], "k string, name string")
    assert rows(R.merged_counts(t, names, "k", "name")) == [(1, "k_zz"), (5, "X")]
    p = spark.createDataFrame([("uno", ["1.1", "2.1"]), ("dos", ["1.1"])], "pattern string, codes array<string>")
    assert R.table_matches(spark.createDataFrame([("uno y dos",)], "t string"), "t", p).first().codes == ["1.1", "2.1"]
    log = spark.createDataFrame([("a|eval", "done"), ("a|eval", "open"), ("a|q", "done")], "key string, status string")
    assert R.finished(log, "key", "eval").count() == 1
    f = spark.createDataFrame([("g", 1, False), ("g", 2, True), ("g", 3, True), ("h", 1, False)], "g string, i int, ok boolean")
    assert rows(R.first_success(f, ["g"], "i", F.col("ok")).select("g", "i")) == [("g", 2)]
    runs = spark.createDataFrame([("EXP-20250101-001-a",), ("EXP-20250101-003-b",), ("EXP-20250102-001-b",)], "exp_id string")
    next_id = lambda d: sinks.allocated(runs, d, "m").first().run_id
    assert (next_id("20250101"), next_id("20250102"), next_id("20250103")) == ("EXP-20250101-002-m", "EXP-20250102-002-m", "EXP-20250103-001-m")


# Texts

def test_catalogue_rules_equal_those_in_python(spark):
    t = spark.read.parquet(f"{MEDIUM}/picked_species_enhanced.parquet").select("habitat_raw", "geographic_notes")
    own = [("Gua-\nnacaste, Divisi6n O—1100 m, FI. ene., Costefia, htiimedo h¬ úmedo 650—2000-1300+? 0-750-1000) m £",), (None,), ("humedo humeda 1000+) SO—) (O-) 5— 60",)]
    texts = [r.t for r in t.select(F.explode(F.array("habitat_raw", "geographic_notes")).alias("t")).collect()] + [x for x, in own]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in X.repaired(df, ["t", "nowhere"], CATALOGUE_RULES).collect()}
    for i, text in enumerate(texts):
        for pattern, new in CATALOGUE_RULES if text is not None else ():
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", new), text)
        assert got[i] == (text.strip() if text is not None else None)


def test_habitat_lines_and_blocks(spark):
    entry = "Ilex alba Smith\nÁrbol de 5 m con hojas\nBosque húmedo, 300-900 m;\nvert. Pac. Cord.\n\nEpífita rara"
    assert one(spark, X.habitat_line("a"), a=entry) == "Bosque húmedo, 300-900 m; vert. Pac. Cord."
    assert one(spark, X.habitat_line("a"), a="hojas de 300-900 m en CR, rara\nBosque\nBosque muy húmedo\n123\nmás") == "Bosque muy húmedo"
    assert one(spark, X.habitat_line("a"), a="hojas de 300-900 m en CR, rara\nnotas\nRosa alba L. es otra") == "hojas de 300-900 m en CR, rara notas"  # the next entry ends it
    assert one(spark, X.habitat_line("a"), a="nada\nde nada") is None and one(spark, X.habitat_line("a"), a=None) is None
    text = "Clave: Ilex alba p. 3\nilex  ALBA sin datos aquí\nILEX alba L.\nBosque a 300-900 m\nQuercus robur"
    block = lambda t, n: tuple(spark.createDataFrame([(t, n)], "t string, n string").select(X.species_block("t", "n", 25).alias("b")).first().b)
    assert block(text, "Ilex alba") == ("ILEX alba L.\nBosque a 300", "exact")  # the first entry has no habitat within the block
    assert block("x Ilex alba Bosque alto", "Ilex alba") == ("Ilex alba Bosque alto", "exact")
    assert block("Quercvs robvrr L.\nhojas", "Quercvsus robvrxyz") == ("Quercvs robvrr L.\nhojas", "fuzzy") and block("nada", "Ilex alba") == ("", "not_found")


def test_slopes(spark):
    kept = lambda text: spark.createDataFrame([(text, ["1.1", "8.1", "8.2", "8.3", "10.1"])], "t string, c array<string>").select(X.sided(F.col("c"), F.col("t"), "carib", "pac", "ambas", {"8": ["2", "3"]}, {"8": ["1", "3"]}).alias("c")).first().c
    assert kept("carib") == ["1.1", "8.2", "8.3", "10.1"] and kept("pac") == ["1.1", "8.1", "8.3", "10.1"]
    assert kept("carib y pac") == kept("ambas carib") == kept("x") == ["1.1", "8.1", "8.2", "8.3", "10.1"]


def test_answers_and_content(spark):
    assert one(spark, X.json_answer("a", "k int"), a="```json\n{\"k\": 3}\n```").k == 3
    long = spark.createDataFrame([(b"x" * 100,)], "b binary").select(X.encoded("b").alias("e")).first().e
    assert "\n" not in long and len(long) == 136


# Reports and statistics

def marks(n=40):
    rng = np.random.default_rng(3)
    return [(f"s{i}", t, m, "A" if i % 2 else "B", float(np.round(rng.random() + 0.3 * j + 0.2 * k, 3))) for i in range(n) for j, t in enumerate(("T0", "T1", "T3")) for k, m in enumerate(("m_b", "m_a", "m_c"))]


def test_reports(spark):
    df = spark.createDataFrame(marks(), "especie string, tier string, model string, stratum string, v double")
    r = P.stratum_report(df, "stratum", ["T0", "T1", "T3"], "v", n_boot=400)
    stats = {(x.stratum, x.tier): x for x in r["tier_stats"].collect()}
    assert set(stats) == {(s, t) for s in ("A", "B", "all") for t in ("T0", "T1", "T3")} and stats["all", "T0"].n == 120
    assert all(x.ci_low < x["mean"] < x.ci_high for x in stats.values())
    assert {x.stratum: x.n_blocks for x in r["friedman"].collect()} == {"A": 20, "B": 20, "all": 40}
    whole_ = {(x.a, x.b): x.w for x in Q.wilcoxon_pairs(df, "especie", "tier", ["T0", "T1", "T3"], "v").collect()}
    assert {(x.a, x.b): x.w for x in r["wilcoxon"].collect() if x.stratum == "all"} == whole_
    g = {x.tier: x for x in P.generator_comparison(df, "model", "v").collect()}
    assert {x.model_1 for x in g.values()} == {"m_a"} and {x.model_2 for x in g.values()} == {"m_b"} and g["T0"].n == 40
    assert g["T0"].mean_1 > g["T0"].mean_2
    assert P.generator_comparison(df.filter("especie in ('s1', 's2')"), "model", "v").count() == 0  # fewer than five pairs
    m = P.metric_report(spark.createDataFrame([("T0", "1", "N/A"), ("T0", "2", None), ("T9", "9", "9")], "tier string, m1 string, m2 string"), ["m1", "m2", "m9"], ["T0"], n_boot=20)
    assert [(x.metric, x.tier, x["mean"], x.n) for x in m.collect()] == [("m1", "T0", 1.5, 2)]
    pairs = spark.createDataFrame([(2, 2.5, None), (3, 3.5, 1.0), (None, 1.0, 2.0)], "h_m1 int, l_m1 double, h_m2 double").withColumn("l_m2", F.lit(None).cast("double"))
    assert rows(P.paired_marks(pairs, ["m1", "m2"])) == [(2, 2, "m1"), (3, 4, "m1")]


def test_tails_against_tables(spark):
    """Friedman's 3.5 and 7.0 with 2 degrees of freedom, the signed-rank table, the normal law."""
    assert Q.chi2_tail(4.605, 2) == pytest.approx(0.1, abs=1e-4) and Q.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4) and Q.chi2_tail(16.812, 6) == pytest.approx(0.01, abs=1e-4)
    assert [round(Q.signed_rank_p(w, n), 4) for w, n in ((2, 7), (8, 10), (25, 15))] == [0.0469, 0.0488, 0.0479]
    assert Q.normal_tails(2.5758) == pytest.approx(0.01, abs=1e-5) and Q.f_tail(3.8853, 2, 12) == pytest.approx(0.05, abs=1e-4)
    df = spark.createDataFrame([(f"s{i}", t, float(v)) for i, vs in enumerate([(1, 2, 3)] * 6) for t, v in zip("abc", vs)], "sp string, t string, v double")
    r = Q.friedman(df, "sp", "t", ["a", "b", "c"], "v").first()
    assert r.chi2 == pytest.approx(12) and r.p == pytest.approx(0.002479, abs=1e-5)
    w = Q.wilcoxon_pairs(df, "sp", "t", ["a", "b", "c"], "v").collect()
    assert all(x.w == 0 for x in w)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("g", float(i % 7)) for i in range(300)] + [("g", float("nan")), ("h", None)], "g string, v double")
    got = [tuple(Q.bootstrap_ci(df.repartition(n), ["g"], "v", 500).select("n", F.round("mean", 9), F.round("low", 9), F.round("high", 9)).first()) for n in (1, 8)]
    assert got[0] == got[1] and got[0][0] == 300
    w = got[0][3] - got[0][2]
    assert w == pytest.approx(2 * 1.96 * 2.0 / 300**0.5, rel=0.2)


# Space

SQUARE = "poly_id int, name string, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"
ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]


def test_large_polygons_and_holes(spark):
    polys = spark.createDataFrame([(1, "big", ring(-1e4, 1e4), [ring(1.0, 2.0)]), (2, "small", ring(0.0, 3.0), None)], SQUARE)
    assert G._gridded(polys, 0.01).count() < 8 * G.CELLS
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.5, 2.5), (3, 9000.0, -9000.0)], "id int, lon double, lat double")
    assert rows(G.polygon_matches(pts, polys, 0.01).select("id", "name")) == [(1, "small"), (2, "big"), (2, "small"), (3, "big")]


def test_annulus_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    p, c = rng.normal(0, 0.3, (400, 2)), rng.uniform(-2, 2, (300, 2))
    df = lambda xs: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xs)], "id int, lon double, lat double")
    d = np.sqrt(((c[:, None] - p[None]) ** 2).sum(2)).min(1)
    for inner, outer in ((0.1, 0.5), (0.0, 0.3), (0.05, 1.0)):
        got = {r.id: r.distance for r in G.annulus(df(c), df(p), inner, outer).collect()}
        want = {i: x for i, x in enumerate(d) if inner < x <= outer}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_background_fails_aloud(spark):
    far = spark.createDataFrame([(1, "p", ring(50.0, 51.0), None)], SQUARE)
    with pytest.raises(ValueError):
        G.uniform_background(spark, 5, (0.0, 0.0, 1.0, 1.0), within=far, most_tries=1000)
    thin = spark.createDataFrame([(1, "p", ring(0.0, 0.02), None)], SQUARE)
    assert G.uniform_background(spark, 20, (0.0, 0.0, 1.0, 1.0), within=thin).count() == 20


def test_clipped_and_stacked_rasters(spark):
    px = spark.createDataFrame([("a", r, c, float(r * 10 + c)) for r in range(4) for c in range(4)] + [("b", r, c, -9.0 if c else 1.0) for r in range(4) for c in range(4)], "layer string, row int, col int, value double")
    grid = G.Grid(0.0, 4.0, 1.0, -1.0, nodata=-9.0)
    region = spark.createDataFrame([(1, "r", ring(0.0, 2.0), None)], SQUARE)
    assert sorted({(r.row, r.col) for r in G.pixels_inside(px, grid, region).collect()}) == [(2, 0), (2, 1), (3, 0), (3, 1)]
    pts = spark.createDataFrame([(1, 0.5, 3.5, "f"), (2, 3.5, 0.5, "g"), (2, 0.5, 3.5, "f")], "id int, lon double, lat double, forest string")
    got = {(r.id, r.forest): r.stack for r in G.patch_stacks(pts, px, grid, ["a", "b"], 1).collect()}
    assert got.keys() == {(1, "f"), (2, "f")}  # the other one's square of layer b is empty
    a, b = got[1, "f"]
    assert a == [5.5, 5.5, 5.5, 5.5, 0.0, 1.0, 5.5, 10.0, 11.0] and b == [1.0] * 9


def test_context(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5, 10), (2, 1.5, 1.5, 20), (3, 9.0, 9.0, 40)], "id int, lon double, lat double, alt int")
    layers = {"uno": spark.createDataFrame([(1, "p", ring(0.0, 2.0), None), (2, "q", ring(1.0, 2.0), None)], SQUARE), "dos": spark.createDataFrame([(3, "z", ring(50.0, 52.0), None)], SQUARE)}
    text = G.context_text(pts, layers, "alt").first().context
    assert "de 10.0 a 40.0 m.s.n.m. (Media: 23.3 m)" in text and "- uno: El 100.0% de los registros caen aquí. Principales: p (2 reg), q (1 reg)." in text and text.index("uno") < text.index("- dos: No hay presencia significativa (0%).")
    assert G.context_text(pts.limit(0), layers).first().context == "No hay presencias válidas para calcular métricas espaciales."


def test_shapley_equals_brute_force(spark):
    """All coalitions of three features, for every row and tree."""
    from itertools import combinations
    from math import factorial

    df = spark.range(200).select("id", *((F.xxhash64("id", F.lit(k)) % 10).cast("double").alias(f"x{k}") for k in range(3)), (F.xxhash64("id") % 2 == 0).cast("int").alias("class"))
    names = ["x0", "x1", "x2"]
    model = M.fit_forest(df, names, trees=3, depth=4)
    x = df.select(*names).toPandas().to_numpy(float)[:6]

    def value(tree, node, row, inside):
        feature, threshold, left, right, share, cover = tree
        f = feature[node]
        if f < 0:
            return share[node]
        if f in inside:
            return value(tree, left[node] if row[f] <= threshold[node] else right[node], row, inside)
        return sum(cover[c] / cover[node] * value(tree, c, row, inside) for c in (left[node], right[node]))

    trees = M._trees(model)
    got = M._forest_shap([M._leaves(t) for t in trees], x)
    for r, row in enumerate(x):
        for i in range(3):
            want = np.mean([sum(factorial(k) * factorial(2 - k) / 6 * (value(t, 0, row, {*s, i}) - value(t, 0, row, set(s))) for k in range(3) for s in combinations([j for j in range(3) if j != i], k)) for t in trees])
            assert got[r, i] == pytest.approx(want, abs=1e-9)
    top = M.limiting(M.shap_values(model, df, names, "id"), names, "id", 2).filter("id = 0").orderBy("place").collect()
    assert [t.place for t in top] == [1, 2] and abs(top[0].value) >= abs(top[1].value)


def test_directory_items(spark):
    files = [("/r/Ilex_alba/T1/llm_profile_m.txt", "x\nPregunta Usuario: ¿dónde?\n[R] aquí"), ("/r/Ilex_alba/T1/a_ficha.txt", "en el tier"), ("/r/Ilex_alba/b_ficha.txt", "arriba"), ("/r/Rosa_alba/T3/llm_profile_n.txt", "sin marca")]
    got = J.directory_items(spark.createDataFrame(files, "path string, text string"), "llm_profile_", "_ficha", "[R]")
    assert rows(got.select("answer", "especie", "ground", "model", "question", "tier")) == sorted([("aquí", "Ilex alba", "arriba", "m", "¿dónde?", "T1"), ("sin marca", "Rosa alba", None, "n", None, "T3")], key=repr)


def test_grid_and_shape_files(spark, tmp_path):
    import struct

    from verbena.sources import readers

    (tmp_path / "bio_1.asc").write_text("ncols 3\nnrows 2\nxllcorner -86.0\nyllcorner 8.0\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n4 -9999 6.5\n")
    px, grid = readers.ascii_grid(spark, str(tmp_path / "bio_1.asc"), "bio_1")
    assert (grid.x0, grid.y0, grid.dx, grid.dy, grid.nodata) == (-86.0, 9.0, 0.5, -0.5, -9999.0)
    pts = spark.createDataFrame([(1, -84.6, 8.9), (2, -85.4, 8.1), (3, -84.6, 8.1)], "id int, lon double, lat double")
    assert dict(G.sampled(pts, px, grid, ["bio_1"]).select("id", "bio_1").collect()) == {1: 3.0, 2: None, 3: 6.5}
    rings = [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]]
    points = [p for r in rings for p in r]
    starts = [0, 5, 10]
    body = struct.pack("<i4d2i", 5, 0, 0, 10, 10, 3, len(points)) + struct.pack("<3i", *starts) + struct.pack(f"<{2 * len(points)}d", *(float(v) for p in points for v in p))
    (tmp_path / "areas.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"nombre\0\0\0\0\0" + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    (tmp_path / "areas.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<iHH", 1, 65, 9) + b"\0" * 20 + field + b"\r" + b" parque  ")
    got = readers.shapefile(spark, str(tmp_path / "areas.*"), "nombre")
    assert rows(got.select("name", F.size("ring").alias("n"), F.size("holes").alias("h"))) == [(0, 4, "parque"), (1, 5, "parque")]
    inside = G.polygon_matches(spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 9.4, 9.8)], "id int, lon double, lat double"), got)
    assert sorted(r.id for r in inside.collect()) == [1, 3]


def test_tukey_and_medians(spark):
    from verbena.operators import windows as W

    assert [round(Q.studentised_range_tail(q, k, df), 3) for q, k, df in ((3.877, 3, 10), (3.578, 3, 20), (4.232, 5, 20), (3.314, 3, 1e9))] == [0.05] * 4
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 11.0), ("b", 12.0), ("b", 13.0)], "g string, v double")
    r = Q.pairwise_differences(g, "g", "v").first()
    assert r.difference == 10 and r.q == pytest.approx(10 / (1 / 3) ** 0.5) and r.p < 0.001
    m = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", 6.0), ("b", 2.0), ("b", float("nan")), ("c", None), (None, 4.0)], "g string, v double")
    assert {x.g: x.median for x in W.medians(m, ["g"], "v").collect()} == {"a": 3.0, "b": 2.0, "c": None, None: 4.0}
    assert W.medians(m, [], "v").first().median == 3.0


def test_database_in_ranges(spark):
    from verbena.sources import readers

    url = "jdbc:derby:memory:verbena;create=true"
    df = spark.range(100).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).cast("int").alias("V"))
    try:
        df.write.format("jdbc").options(url=url, dbtable="T").mode("overwrite").save()
    except Exception as e:  # no embedded database beside Spark
        pytest.skip(str(e)[:80])
    got = readers.jdbc(spark, url, "T", "ID", 0, 100, 4)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("V")).first()[0] == 9900
