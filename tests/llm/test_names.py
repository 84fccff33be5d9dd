import random

from conftest import rows
from verbena.llm.names import _edits, edits, form, map_names, similar_pairs, tokens
from pyspark.sql import functions as F

LIST = "ref_id bigint, species string, synonyms array<string>, name string, l string"
ROWS = "src_table string, row_id bigint, name string, ref_id string, form int, tokens string"
NAMES = [(1, "Rosa canina", ["Rosa vulgaris"], "z", "q"), (2, "Quercus robur", [], None, None), (3, "Quercus ilex", None, "z", "q")]


def mapped(spark, names, listed=NAMES):
    data = [("t", i, n, "x", 0, "y") for i, n in enumerate(names)]
    got = map_names(spark.createDataFrame(data, ROWS).select("src_table", "row_id", "name"), spark.createDataFrame(listed, LIST).select("ref_id", "species", "synonyms"))
    return {r.row_id: r.ref_id for r in got.select("row_id", "ref_id").distinct().collect()}


def test_forms_of_a_name(spark):
    good = ["ROSA CANINA", "rosa canína ", "R0sa can1na", "Rosa canina L.", "Rosa cf. canina", "Rosa canina?", "canina, Rosa", "canina (Rosa)", "Rosa canina (Rosaceae)", "Rosaceae: Rosa canina", "R. canina", "R.canina", "Rosa caniina", "Rsoa canina", "Rosa canina var. alba", "Rosa canina [Rosaceae]", "Rosa vulgaris", "Rosa_canina"]
    assert mapped(spark, good) == {i: 1 for i in range(len(good))}
    none = ["Rosa", "Rosa sp.", "Rosa sp. 2", "Rosaceae", "pendiente", "Rosa spp.", "Rosa indet.", "Rosa gigantea", "ver foto 9", "N/A", "...", "Zea mays", "x" * 30_000, "Q. canina"]
    assert mapped(spark, none) == {i: 0 for i in range(len(none))}


def test_no_case_and_empty(spark):
    assert mapped(spark, [None, "", "   ", "Rosa canina", "Quercus ilex"]) == {}
    assert mapped(spark, []) == {}
    assert mapped(spark, ["Rosa canine"], []) == {0: 0}
    assert mapped(spark, ["Quercus robu", "Quercus robu", "Quercus ile"]) == {0: 2, 1: 2, 2: 3}


def test_join_is_exact(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 7)))
    left, right = [f"{word()} {word()}" for _ in range(60)], [f"{word()} {word()}" for _ in range(60)]
    make = lambda xs, k: spark.createDataFrame([(x, False) for x in sorted(set(xs))], f"{k} string, kind boolean").withColumn("tokens", tokens(F.col(k)))
    a, b = make(left, "l"), make(right, "r")
    got = {(r.l, r.r): r.jaccard for r in similar_pairs(a, b, 0.5).collect()}
    sets = lambda df, k: {r[k]: set(r.tokens) for r in df.collect()}
    want = {(x, y): len(s & t) / len(s | t) for x, s in sets(a, "l").items() for y, t in sets(b, "r").items() if len(s & t) / len(s | t) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_join_with_common_tokens_and_tiny_sets(spark, monkeypatch):
    from verbena.llm import names

    rnd = random.Random(2)
    for common in (0, 2):
        monkeypatch.setattr(names, "COMMON", common)
        sets = lambda n, k: {f"{k}{i}": sorted({rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 9))}) for i in range(n)}  # noqa: B023, E731
        left, right = sets(40, "l"), sets(40, "r")
        make = lambda d, k: spark.createDataFrame([(x, False, t) for x, t in d.items()], f"{k} string, kind boolean, tokens array<string>")
        for threshold in (0.5, 0.8):
            got = sorted((r.l, r.r) for r in similar_pairs(make(left, "l"), make(right, "r"), threshold).collect())
            want = sorted((x, y) for x, s in left.items() for y, t in right.items() if s and t and len({*s} & {*t}) >= threshold * len({*s} | {*t}) - 1e-9)
            assert got == want


def test_short_hyphened_and_other_letters(spark):
    listed = [(1, "Ia io", [], "z", "q"), (2, "Epi-dendrum nocturnum", [], "z", "q"), (3, "Epi-dendrum noctis", [], "z", "q"), (4, "Роза майская", [], "z", "q"), (5, "Rosa canina", [], "z", "q")]
    names = ["IA IO", "Ia sp.", "epi-dendrum nocturnum L.", "Epidendrum noctis", "роза майска", "Rosa-canina", "Rosa dc", "Ia ix"]
    assert mapped(spark, names, listed) == {0: 1, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1}


def test_most_alike_wins_before_fewest_edits(spark):
    listed = [(1, "Quercus robur", [], "z", "q"), (2, "Quercus rabora", [], "z", "q")]
    assert mapped(spark, ["Quercus robura", "Quercus robru"], listed) == {0: 1, 1: 1}


def test_candidates_grow_linearly_with_the_vocabulary(spark, monkeypatch):
    """Ten times as many listed names of new words: the pairs that the join brings together per typed name stay about as many."""
    from verbena.llm import names

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    met = []
    join = names.checked_join
    monkeypatch.setattr(names, "checked_join", lambda a, b, keys, *x, **o: (met.append(out.count() if "key" in keys and "lp" in a.columns else None), out)[1] if (out := join(a, b, keys, *x, **o)) is not None else None)
    make = lambda xs, k: spark.createDataFrame([(x, False) for x in xs], f"{k} string, kind boolean").withColumn("tokens", tokens(F.col(k)))
    names_ = [f"{word(8)} {word(9)}" for _ in range(20_000)]
    for n in (2_000, 20_000):
        similar_pairs(make([x[:-1] for x in names_[:300]], "l"), make(names_[:n], "r"), 0.5).count()
    few, many = [m for m in met if m is not None]
    assert many <= 12 * few and many / 300 < 0.2 * 20_000


def test_edits(spark):
    assert [_edits("abc", x) for x in ("abc", "acb", "ab", "xbc", "")] == [0, 1, 1, 1, 3]
    df = spark.createDataFrame([("abcd", "abdc")], "a string, b string")
    assert df.select(edits("a", "b").alias("e")).first().e == 1
    assert rows(spark.createDataFrame([("Rosa",), (None,)], "n string").select(form(F.col("n")).alias("f"))) == [(None,), (None,)]
