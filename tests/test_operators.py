import inspect
import json
import math
import unicodedata
import zipfile

import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from verbena.functions import canonical_key, micros_of_ntz, micros_of_text
from verbena.functions import text as X
from verbena.operators import aggregates as A
from verbena.operators import geo as G
from verbena.operators import ml as M
from verbena.operators import relational as R
from verbena.operators import scoring as S
from verbena.operators import stats as Q
from verbena.operators import windows as W
from verbena.runtime import at_most, checked_join
from verbena.sources import readers, sinks
from verbena.streaming import incremental as I

LOOSE = dict(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


# Keys and clocks

def test_keys_and_times(spark):
    assert one(spark, canonical_key("a"), a="  Ex.P--1_Ñu ") == "ex_p_1_ñu" and one(spark, canonical_key("a"), a="--") == "" and one(spark, canonical_key("a"), a=None) is None
    times = ["2025-01-01T00:00:00", "2025-01-01 00:00:00Z", "2024-12-31T18:00:00-06:00", "2025-01-01"]
    assert len({one(spark, micros_of_text("a"), a=t) for t in times}) == 1
    assert one(spark, micros_of_text("a"), a="never") is None
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, micros_of_text("a"), a="1970-01-01T00:00:01") == 1_000_000
        assert spark.sql("select timestamp_ntz'1970-01-01 00:00:01' t").select(micros_of_ntz("t").alias("x")).first().x == 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_checked_join_both_ways(spark, how):
    big = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(60)], "id int, k int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k int, v string")
    assert rows(checked_join(big, small, ["k"], how)) == rows(checked_join(big, small, ["k"], how, max_rows=1)) == rows(big.join(small, "k", how))
    assert at_most(small, 4) and not at_most(small, 3)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_a_counted_side_is_not_broadcast_by_an_estimate(spark, monkeypatch):
    """beyond the bound nothing is broadcast, whatever Spark thinks of its size, and no side is copied."""
    import verbena.runtime as V

    t = spark.createDataFrame([("a", 3), ("b", 2), ("zz", 1)], "k string, n bigint")
    names = spark.createDataFrame([("a", "X"), ("b", "X")], "k string, name string")
    monkeypatch.setattr(V.checked_join, "__defaults__", ("inner", 1, ()))
    out = R.merged_counts(t, names, "k", "name")
    assert joins(out) == (False, True) and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == [(1, "k_zz"), (5, "X")]


def test_parents_beyond_the_bound_are_joined_in_shuffles(spark, monkeypatch):
    """every level of parents, and rows without a key."""
    import verbena.runtime as V

    child = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "id int, k int")
    first, second = spark.createDataFrame([(1, "a"), (7, "x")], "k int, parent string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, parent string")
    monkeypatch.setattr(V.checked_join, "__defaults__", ("inner", 1, ()))
    out = R.with_parents(child, [(first, ["k"]), (second, ["k"])], "parent", F.lit("none"))
    assert joins(out) == (False, True)
    assert rows(out.select("id", "parent")) == [(1, "a"), (2, "q"), (3, "none"), (4, "none")]


def test_the_bound_of_a_broadcast_counts_bytes(spark):
    """few rows of long arrays and texts are as much as many rows."""
    from verbena.runtime import fits

    wide = spark.range(1_000).select("id", F.sequence(F.lit(1), F.lit(10_000)).cast("array<bigint>").alias("a"), F.struct(F.lit("x").alias("s")).alias("b"), F.create_map(F.lit("k"), F.array(F.lit("v"))).alias("m"))
    assert not fits(wide) and fits(wide.select("id", "b", "m")) and fits(wide, max_bytes=100_000_000)
    assert fits(wide.limit(0)) and not fits(wide.select("id"), 999)
    keyed = spark.range(1_000).select("id")
    assert joins(checked_join(keyed, wide, ["id"])) == (False, True) and joins(checked_join(keyed, wide.select("id", "b"), ["id"])) == (True, False)


# Relational

def test_columns(spark):
    df = spark.createDataFrame([(1, "a", " ")], "id int, name string, alt string")
    assert R.existing(df, ["name", "gone", "id"]).columns == ["name", "id"] and R.excluding(df, ["id"], ["alt"]) == ["name"] and R.matching(df, ["al", "na"]) == ["name", "alt"]
    assert R.with_constants(df, {"run": 7}, first=True).columns[0] == "run" and df.select(R.first_existing(df, ["gone", "name"]).alias("x")).first().x == "a"
    assert df.select(R.fallback("alt", "name").alias("x")).first().x == "a" and df.select(R.remap("name", {"a": "b"}).alias("x"), R.remap("alt", {}).alias("y")).first() == ("b", " ")
    assert R.prefixed(df, "h_", ["id"]).columns == ["id", "h_name", "h_alt"]


def test_three_states(spark):
    df = spark.createDataFrame([("N/A",), (None,), ("",), ("2.5",), ("True",), ("nan",), ("x",)], "v string")
    assert [r.s for r in df.select(R.state("v").alias("s")).collect()] == ["not_applicable", "missing", "missing", "number", "number", "missing", "missing"]
    assert [r.n for r in df.select(R.number("v").alias("n")).collect()] == [None, None, None, 2.5, 1.0, None, None]


def test_upsert_keeps_other_columns(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, keep string")
    u = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "k int, v string, keep string")
    assert rows(R.upsert(t, u, ["k"], ["v"])) == sorted([(1, "x", "a"), (2, "y", "B"), (3, "new", "C")], key=repr)
    assert rows(R.insert_absent(t, u, ["k"]).select("k")) == [(1,), (2,), (3,)]
    r = spark.createDataFrame([(1, None, "z")], "k int, v string, keep string")
    assert rows(R.assigned(t, r, "k")) == [(1, "z", "a"), (2, "y", "b")]


def test_plans_pairs_and_bands(spark):
    sp, ti = spark.createDataFrame([("s",), ("t",)], "sp string"), spark.createDataFrame([("T0",), ("T1",)], "tier string")
    done = spark.createDataFrame([("s", "T0")], "sp string, tier string")
    assert rows(R.work_plan([sp, ti], done, ["sp", "tier"])) == [("s", "T1"), ("t", "T0"), ("t", "T1")]
    with pytest.raises(ValueError):
        R.work_plan([sp, ti], done, ["sp", "tier"], max_rows=1)
    v = spark.createDataFrame([("s", "T0", 1.0), ("s", "T1", 2.0), ("s", "T3", 3.0)], "sp string, tier string, v double")
    assert len(rows(R.unordered_pairs(v, ["sp"], "tier", "v"))) == 3
    b = R.in_bands(spark.createDataFrame([(5,), (50,), (None,)], "h int"), "h", [("a", 0, 10), ("b", 5, 60)])
    assert rows(b) == [("a", 5), ("b", 5), ("b", 50)]
    p = R.pattern_matches(spark.createDataFrame([("x1",), (None,)], "t string"), "t", [("x", ["A", "B"]), ("1", ["B"])])
    assert [r.codes for r in p.collect()] == [["A", "B"], []]
    assert rows(R.stacked(sp, ti)) == rows(spark.createDataFrame([("s", None), ("t", None), (None, "T0"), (None, "T1")], "sp string, tier string"))


# Windows

@settings(**LOOSE)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 9))), max_size=60))
def test_ranks(spark, data):
    df = spark.createDataFrame(data, "g string, v int")
    got = {(r.g, r.v): r["rank"] for r in W.value_ranks(df, ["g"], "v").collect()}
    want = {}
    for g in "ab":
        s = pd.Series([v for k, v in data if k == g and v is not None], dtype=float)
        want |= {(g, int(v)): r for v, r in zip(s, s.rank())}
    assert got == want


def test_numbering_gaps_cycles_samples(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert [r.n for r in W.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1, 1001))
    gaps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("b", 2), ("c", 0)], "d string, n int")
    assert dict(W.first_gap(gaps, ["d"], "n").collect()) == {"a": 3, "b": 1}
    items = spark.createDataFrame([(f"s{i}", "p") for i in range(25)], "item string, g string")
    got = W.cyclic_assignment(items, "item", "g", {"p": list("abcdefghij")}).groupBy("entry").count().collect()
    assert len(got) == 10 and {r["count"] for r in got} <= {2, 3}
    assert rows(W.sample_n(df, "k", 5)) == rows(W.sample_n(df, "k", 5)) != rows(W.sample_n(df, "k", 5, seed=1)) and W.sample_n(df, "k", 9999).count() == 1000
    split = W.stratified_split(df.withColumn("y", (F.col("k") < 100).cast("int")), "y", "k").groupBy("y", "is_test").count().collect()
    assert {(r.y, r.is_test): r["count"] for r in split} == {(1, True): 20, (1, False): 80, (0, True): 180, (0, False): 720}


def test_split_of_many_classes(spark):
    df = spark.range(201_000).select(F.col("id").alias("label"), F.lit(1).alias("key"))
    assert W.stratified_split(df, "label", "key").agg(F.count("*"), F.count_if("is_test")).first()[:] == (201_000, 0)


def test_auc_and_latest(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (None, 0.3), (1, None)], "y int, s double")
    r = W.rank_auc(df, "y", "s").first()
    assert r.auc == 0.875 and (r.n1, r.n0) == (2, 2)
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "g string, o int, v string")
    assert rows(W.latest(t, ["g"], ["o"])) == sorted([("a", 2, "y"), (None, 1, "z")], key=repr)


# Statistics

def test_tails():
    assert Q.chi2_tail(5.991464547, 2) == pytest.approx(0.05) and Q.normal_tails(1.959963985) == pytest.approx(0.05)
    assert Q.f_tail(4.964602744, 1, 10) == pytest.approx(0.05) and Q.signed_rank_p(0, 5) == pytest.approx(0.0625)


def test_friedman_and_wilcoxon(spark):
    data = [(f"s{i}", t, v) for i, vs in enumerate([(1, 2, 3), (2, 2, 3), (1, 3, 2), (1, 2, 4), (2, 3, 4), (5, 6, None)]) for t, v in zip(("T0", "T1", "T3"), vs)]
    df = spark.createDataFrame([(a, b, None if v is None else float(v)) for a, b, v in data], "sp string, tier string, v double")
    r = Q.friedman(df, "sp", "tier", ["T0", "T1", "T3"], "v").first()
    assert r.n_blocks == 5 and r.w_textbook == pytest.approx(r.chi2 / 10) and r.w_code == pytest.approx(r.chi2 / 12) and r.p == pytest.approx(math.exp(-r.chi2 / 2))
    w = {(x.a, x.b): x for x in Q.wilcoxon_pairs(df, "sp", "tier", ["T0", "T1", "T3"], "v").collect()}
    assert w["T0", "T1"].n == 6 and w["T0", "T1"].n_nonzero == 5 and w["T0", "T1"].w == 0 and w["T0", "T1"].p_bonferroni <= 1
    assert Q.friedman(df.limit(0), "sp", "tier", ["T0", "T1"], "v").first().chi2 is None


def test_kappa_anova_bootstrap(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 1), (None, 1)], "a int, b int")
    assert Q.weighted_kappa(pairs, "a", "b").first().kappa == pytest.approx(1 - 1 / (16 / 4 * 0 + sum(abs(x - y) for x in (0, 1, 2, 2) for y in (0, 1, 2, 1)) / 4))
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("b", float("nan")), (None, 1.0)], "g string, v double")
    r = Q.anova(g, "g", "v").first()
    assert (r.df_between, r.df_within) == (1, 2) and r.f == pytest.approx(6.25 / 1.25)
    b = {x.g: x for x in Q.bootstrap_ci(spark.range(4000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 10).cast("double").alias("v")), ["g"], "v", 400).collect()}
    assert b["0"].n == 2000 and b["0"].mean == pytest.approx(4.0) and b["0"].high - b["0"].low == pytest.approx(2 * 1.96 * math.sqrt(8 / 2000), rel=0.15)


def test_bootstrap_draws_as_many_as_the_reference():
    assert inspect.signature(Q.bootstrap_ci).parameters["n_boot"].default == 10_000


def test_groups(spark):
    df = spark.createDataFrame([("a", "T0", 1.0), ("a", "T1", 3.0), ("a", "T1", float("nan")), ("b", "T0", None)], "g string, t string, v double")
    assert {r.g: (r.n, r["mean"]) for r in A.describe(df, ["g"], "v").collect()} == {"a": (2, 2.0), "b": (0, None)}
    assert rows(A.value_counts(df, "g", 1)) == [("a", 3)]
    assert {r.v for r in A.filled_with_mean(df, ["g"], "v").collect()} == {1.0, 3.0, 2.0, None}
    assert A.share_of(df, F.col("v") > 1).first().n == 4 and A.share_of(df.limit(0), F.lit(True)).first().pct is None


# Scores: recorded cases (tier, profile, M1..M5, score)

@pytest.mark.parametrize(
    "tier,perfil,m,score",
    [
        ("T0", "botanico", (2.5, "N/A", 3.0, "N/A", 2.5), 0.8889), ("T0", "botanico", (0.5, "N/A", 1.5, "N/A", 1.0), 0.3333), ("T3", "botanico", (1.5, 1.5, 3.0, 1.5, 3.0), 0.8077), ("T3", "botanico", (1.5, "N/A", 2.5, "N/A", 2.5), 0.7222),
        ("T1", "botanico", (0.5, "N/A", 0.0, "N/A", 0.5), 0.1111), ("T3", "random", (2.5, 2.0, 3.0, 1.5, 2.5), 0.9091), ("T3", "random", (2.5, "N/A", 3.0, 2.0, 3.0), 0.9444), ("T0", "random", (1.0, "N/A", 1.0, "N/A", 1.0), 0.2), ("T3", "random", (3, None, 3, None, 3), 0.8182),
    ],
)
def test_composite(spark, tier, perfil, m, score):
    cols = [F.lit(None if x is None else str(x)) for x in m]
    assert one(spark, S.composite(*cols, F.lit(tier), F.lit(perfil)), a="") == pytest.approx(score, abs=5e-5)
    assert one(spark, S.composite(*cols, F.lit(tier), F.lit(perfil), F.lit(False)), a="") <= 0.1


def test_judges(spark):
    mean = lambda a, b: one(spark, S.judge_mean(F.lit(a), F.lit(b)), a="")
    assert (mean("1", "2"), mean("N/A", "2"), mean("1", None), mean(None, None)) == ("1.5", "N/A", "1.0", None)
    assert one(spark, S.largest_difference([(F.lit("1"), F.lit("3")), (F.lit("N/A"), F.lit("3"))]), a="") == 2
    assert one(spark, S.family(F.col("a")), a="OpenAI/gpt-4o") == "openai" and one(spark, S.family(F.col("a")), a="x") == "unknown"
    assert one(spark, S.independent_judge(F.lit("gpt-4"), F.lit("openai/j"), F.lit("claude-j")), a="") == "claude-j"
    assert one(spark, S.elevation_plausibility(F.array(F.lit(100), F.lit(900)), F.lit(200), F.lit(500)), a="") == 1


# Text

@pytest.mark.parametrize(
    "fragment,want",
    [("0–1200 m", (0, 1200, None, None)), ("100–450 m", (100, 450, None, None)), ("(0-)700-1700 m", (700, 1700, 0, None)), ("(50-)300–1700(-2000) m", (300, 1700, 50, 2000)), ("(700-) 1100-2000 m", (1100, 2000, 700, None)), ("(0-)100-800(-1300) m", (100, 800, 0, 1300)), ("(100—)1000–1800 m", (1000, 1800, 100, None)), ("0– 1900 m", (0, 1900, None, None)), ("0–700 (—1000) m", (0, 700, None, 1000)), ("200–800 (100–900) m", (200, 800, 100, 900)), ("hasta 850 m", (850, 850, None, None)), ("nada", (None,) * 4)],
)
def test_elevation_range(spark, fragment, want):
    assert tuple(one(spark, X.elevation_range("a"), a=f"Bosque, {fragment}; N Cord.")) == want


@pytest.mark.parametrize("text,want", [("Vive entre 1220 y 320 m.", [320, 1220]), ("100 a 2.500 m", [100, 2500]), ("Desde 900 hasta 1.800 msnm", [900, 1800]), ("de 5 a 700 metros", [5, 700]), ("8 m y 90 m; 0-5 m", [0, 5, 8, 90]), ("entre 3 y 7 hojas, 20 m", [20])])
def test_both_ends_of_worded_ranges(spark, text, want):
    assert one(spark, X.elevations("a"), a=text) == want


def test_text_functions(spark):
    s = "Bosque, potreros, (0-)300-1200 m; vert. Pac. Cord. (rara). Fl. mar."
    assert one(spark, X.habitat_type("a"), a=s) == "Bosque" and one(spark, X.geographic_notes("a"), a=s) == "vert. Pac. Cord."
    assert one(spark, X.elevations("a"), a="de 1.200 m a 90 m, 500–800 msnm, 9999 m") == [90, 500, 800, 1200]
    assert one(spark, X.unaccented("a"), a="Ñandú É") == "nandu e" and one(spark, X.slug("a"), a="a/b c-d:e") == "a_b_c_d_e" and one(spark, X.titled("a"), a="selva_nublada") == "Selva Nublada"
    assert one(spark, X.unfenced("a"), a='x\n```json\n{"k": 1}\n```') == '{"k": 1}' and one(spark, X.after_marker("a", "[R]"), a="q [R] z ") == "z"
    assert one(spark, X.header_value("a", "Pregunta"), a="x\nPregunta Usuario: ¿qué? \ny") == "¿qué?" and one(spark, X.section("a", "Hábitat"), a="a\nHábitat\nuno\ndos\n\ntres") == "uno\ndos"
    assert one(spark, X.filled("{a} y {b}", {"a": F.col("a"), "b": F.lit(None)}), a="uno") == "uno y " and one(spark, X.ruled("a", [("á", "a"), ("aa", "b")]), a="áa") == "b"
    assert one(spark, X.best_line("a", ["^Selva", "m$"]), a="x\nSelva alta\nde río.\nno") == "Selva alta de río."


def test_accent_fold_of_all_texts(spark, tmp_path):
    from verbena.plans.texts import accent_fold

    def fold(s):
        out = ""
        for c in s:
            d = unicodedata.normalize("NFD", c)
            out += d[0] if unicodedata.name(c, "").startswith("LATIN") else c
        return "".join(c for c in out if not "\u0300" <= c <= "\u036f").lower()

    texts = ["Ñandú É", "Tiếng Việt Ắ", "ǽ Ǿ ș", "e\u0301 à", "中文 é ガ", "हिन्दी ไทย عربي Й ή", "😀 Ÿ", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(accent_fold(spark, tmp_path).collect()) == {i: fold(t) for i, t in enumerate(texts)}


# Space and learning

def test_points_polygons_and_rasters(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]
    polys = spark.createDataFrame([(1, "a", square), (2, "b", square[:3]), (3, "bad", square[:2])], "poly_id int, name string, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 1.5, 0.5), (2, 0.5, 1.5), (3, 5.0, 5.0), (4, None, 1.0)], "id int, lon double, lat double")
    assert rows(G.polygon_matches(pts, polys, 0.7).select("id", "name")) == [(1, "a"), (1, "b"), (2, "a")]
    assert dict(G.first_polygon(pts, polys, "id").select("id", "name").collect()) == {1: "a", 2: "a", 3: "unknown", 4: "unknown"}
    px = spark.createDataFrame([("l", r, c, float(r * 10 + c)) for r in range(3) for c in range(3)] + [("l", 3, 3, -9.0)], "layer string, row int, col int, value double")
    grid = G.Grid(0.0, 3.0, 1.0, -1.0, nodata=-9.0)
    got = dict(G.sampled(pts, px, grid, ["l"]).select("id", "l").collect())
    assert got == {1: 21.0, 2: 10.0, 3: None, 4: None}
    m = G.environment_matrix(pts.filter("id = 1"), pts.filter("id > 1"), px, grid, ["l"])
    assert {(r.id, r["class"], r.l) for r in m.collect()} == {(1, 1, 21.0), (2, 0, 10.0)}
    p = G.patches(pts.filter("id = 2").withColumn("lon", F.lit(1.5)).withColumn("lat", F.lit(1.5)), px, grid, "l", 1).first().patch
    assert p == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0, 20.0, 21.0, 22.0]
    a = G.annulus(pts.filter("id = 2"), pts.filter("id = 1"), 1.0, 2.0)
    assert a.first().distance == pytest.approx(math.sqrt(2)) and G.annulus(pts, pts, 0.5, 1.0).count() == 0


def test_forest_and_shapley(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") * 7 % 13).cast("double").alias("z"), (F.col("id") % 20 > 9).cast("int").alias("class"))
    model = M.fit_forest(df, ["x", "z"], trees=5, depth=3)
    pred = M.predict(model, df, ["x", "z"])
    r = M.measures(pred).first()
    assert r.accuracy > 0.95 and r.auc > 0.95 and r.tp + r.fp + r.fn + r.tn == 400
    shap = M.shap_values(model, df, ["x", "z"], "id").toPandas().set_index("id")
    score = pred.select("id", "score").toPandas().set_index("id").score
    rest = (score - shap.x - shap.z).dropna()
    assert rest.std() < 1e-6  # contributions add up to the score less its mean
    top = {x.feature: x for x in M.shap_summary(M.shap_values(model, df, ["x", "z"], "id"), df, ["x", "z"], "id").collect()}
    assert top["x"].mean_abs > top["z"].mean_abs and top["x"].direction == "POSITIVE"


# Sources, sinks, streams

def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.tsv").write_text("species\tn\nA b\t1\nbad line\nC d\tx\n")
    assert rows(readers.tsv(spark, str(tmp_path / "a/t.tsv"), "species string, n int", ["species"]))[:1] == [("A b",)]
    (tmp_path / "q.csv").write_text('id,text\n1,"dos\nlíneas, ""sí"""\n')
    assert readers.csv(spark, str(tmp_path / "q.csv"), "id int, text string").first().text == 'dos\nlíneas, "sí"'
    (tmp_path / "r.txt").write_text("=====\nRosa canina   Rosaceae   12\n\nQuercus robur\tFagaceae\t7\n")
    assert rows(readers.ragged(spark, str(tmp_path / "r.txt"))) == [("Quercus robur", "7"), ("Rosa canina", "12")]
    (tmp_path / "l.txt").write_text("# c\n a \n\nb\n")
    assert rows(readers.line_list(spark, str(tmp_path / "l.txt"))) == [("a",), ("b",)]
    (tmp_path / "log.json").write_text(json.dumps({"a|q|p": {"status": "done"}, "b|p": "text"}))
    assert sorted(r.key for r in readers.json_log(spark, str(tmp_path / "log.json")).collect()) == ["a|q|p", "b|p"]
    assert readers.json_documents(spark, str(tmp_path / "none"), "a int").count() == 0
    assert {r.name for r in readers.files(spark, str(tmp_path), "*.txt").collect()} == {"r.txt", "l.txt"}
    geo = {"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[2, 2], [3, 2], [3, 3]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    assert sorted(r.name for r in readers.geojson(spark, str(tmp_path / "g.json")).collect()) == ["m", "m", "p"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("bio_1.tif", b"x")
        z.writestr("readme", b"y")
    assert [r.member for r in readers.zip_members(spark, str(tmp_path / "z.zip"), ".tif", "bio").collect()] == ["bio_1.tif"]


def test_many_documents_take_few_tasks(spark, tmp_path):
    """a file per document, with odd names; folders are listed, and many files are read by a task."""
    names = ["_a", ".b", "a/b c+%41", "", "ñ=1", *(f"EXP-{i}" for i in range(300))]
    df = spark.createDataFrame([(n, json.dumps({"n": n, "k": {n: 1}})) for n in names] + [(None, "{}")], "name string, doc string")
    assert sinks.documents(df, str(tmp_path / "d"), "name", "doc") == len(names) == len(list((tmp_path / "d").glob("*/*.json")))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with readers.small_files(spark):
        docs = readers.json_documents(spark, str(tmp_path / "d"), "n string", "*.json").withColumn("name", readers.document_name(F.col("path")))
        assert docs.rdd.getNumPartitions() <= 8
        assert sorted((r.n, r.name) for r in docs.collect()) == sorted((n, n) for n in names)
        log = readers.json_log(spark, str(tmp_path / "d"), "*.json")
        assert sorted(r.key for r in log.collect()) == sorted(["n", "k"] * len(names))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert readers.json_documents(spark, str(tmp_path / "none"), "n string", "*.json").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc'), (2, None)], "id int, t string")
    sinks.csv(df, str(tmp_path / "c"), one_file=True)
    sinks.csv(df, str(tmp_path / "c"), append=True)
    assert readers.csv(spark, str(tmp_path / "c"), "id int, t string").count() == 4
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.schema("id int").json(str(tmp_path / "j")).count() == 2
    assert sinks.markdown(df.select("id")).splitlines()[2:] == ["| 1 |", "| 2 |"]
    sinks.text_cards(df, str(tmp_path / "t"), "n=%s t=%s", ["id", "t"])
    r = sinks.run_ids(spark.sql("select date'2026-05-04' d, 1 n, 'mixed' l"), "d", "n", "l").first()
    assert r.run_id == "EXP-20260504-001-mixed"


def test_streams_resume(spark, tmp_path):
    src, done, log = (str(tmp_path / x) for x in ("src", "done", "log"))
    write = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "u string, i int").coalesce(1).write.mode("append").parquet(src)
    write(["a", "b", "a"])
    run = lambda: I.each_new_unit(I.folder_stream(spark, src, "u string, i int"), done, ["u"], lambda d: d.select("u"), log).awaitTermination()
    run()
    write(["b", "c"])
    run()
    assert rows(spark.read.parquet(done)) == [("a",), ("b",), ("c",)]
    got = I.run_available(I.running_counts(I.folder_stream(spark, src, "u string, i int"), "u", "i", ["i"]), "running_test", str(tmp_path / "cp"))
    assert {r.u: r.n for r in got.collect()} == {"a": 2, "b": 2, "c": 1}
