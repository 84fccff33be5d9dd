import random

from verbena.llm import leakage as L

DOC = "doc_id bigint, text string, item_id string, share string, lang string"
ITEM = "item_id bigint, text string, doc_id string, lang string"
RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(6)) for _ in range(400)]


def sentence(n=20):
    return " ".join(RND.choice(WORDS) for _ in range(n)).capitalize()


ITEMS = [[sentence() for _ in range(4)] for _ in range(5)]
FILL = [sentence() for _ in range(6)]


def found(spark, docs, items=None, **options):
    d = spark.createDataFrame([(i, t, "x", "y", "es") for i, t in enumerate(docs)], DOC)
    e = spark.createDataFrame([(k, ". ".join(s) + ".", "x", "es") for k, s in enumerate(ITEMS)] if items is None else items, ITEM)
    return {(r.doc_id, r.item_id) for r in L.leaks(d, e, **options).collect()}


def test_passages(spark):
    s = ITEMS[2]
    slip = s[1].split()
    slip[3], slip[9] = "otra", slip[9][:2] + slip[9][3:]
    docs = [
        f"{FILL[0]}. {'. '.join(s)}. {FILL[1]}.",  # whole
        f"{FILL[0]}. {s[1].upper()} ; {s[2]}! {s[3]}",  # three quarters
        f"{FILL[0]}. {s[0]}. {s[1]}.",  # a half only
        f"{s[0]}. {FILL[2]}. {s[1]}. {s[2]}.",  # one foreign sentence in between
        f"{s[0]}. {'. '.join(FILL)}. {'. '.join(FILL)}. {s[1]}. {s[3]}.",  # torn apart
        f"{s[0]}. {' '.join(slip)}. {s[2]}.",  # slips
        s[1],
        None,
        "",
        ". ".join(ITEMS[0]) + " " + ". ".join(ITEMS[4]),  # two items
        f"{FILL[0]} " * 3_000 + ". ".join(s),  # very long
        f"{s[3]}. {s[2]}. {s[1]}. {s[0]}.",  # out of order
    ]
    want = {(0, 2), (1, 2), (3, 2), (5, 2), (9, 0), (9, 4), (10, 2)}
    assert found(spark, docs) == want
    assert found(spark, docs, block_chars=700) == want  # several indexes


def test_scripts_without_spaces(spark):
    text = "接近七点八的酸度在旱季一侧明显让幼体多得到八周的庇护据说即使飞蛾很多也是如此下方的玄武岩岩脉局部把相距很远的种群隔开"
    items = [(1, text, "x", "zh")]
    assert found(spark, ["果实从未被采集过。" + text[:45] + "，叶片狭长。", "果实从未" + text[:20]], items) == {(0, 1)}


def test_empty_tables_and_short_items(spark):
    assert found(spark, []) == set()
    assert found(spark, ["a b c d"], []) == set()
    short = [(1, "uno dos", "x", "es"), (2, None, "x", "es"), (3, "", "x", "es"), (4, "¿Tres?", "x", "es"), (5, "七点", "x", "zh"), (6, "uno, DOS!", "x", "es")]
    assert found(spark, ["uno dos", "uno", "a UNO  dós b tres", "dos uno", "接近七点八", None], short) == {(0, 1), (0, 6), (2, 1), (2, 6), (2, 4), (4, 5)}


def test_one_foreign_sentence_of_any_length(spark):
    s = ITEMS[2]
    for n in (50, 60, 700):
        assert found(spark, [f"{s[0]}. {s[1]}. {sentence(n)}. {s[2]}. {s[3]}."]) == {(0, 2)}
    half = sentence(30)
    assert found(spark, [f"{s[0]}. {s[1]}. {half}. {sentence(30)}. {half}. {s[2]}."]) == set()


def test_scan_equals_brute_force():
    """The vectorised probe meets exactly the windows that equal one of the item's."""
    rnd = random.Random(3)
    words = ["uno", "Dós", "tres", "七", "点", "ก", "cinco", "ﬁn", "ñu"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(40)]
    ix = L.Index([(i, t) for i, t in enumerate(texts[:8])])
    for t in texts[8:]:
        tokens, weights, spans = L.tokenise(t)
        ids = L.np.array([ix.vocabulary.get(x, -1) for x in tokens])
        starts, lengths, _ = L.windows(ids, L.np.array(weights))
        want = []
        for k in range(len(tokens)):
            e, w = k, 0
            while e < len(tokens) and w < L.GRAM:
                w += weights[e]
                e += 1
            if w >= L.GRAM and all(x in ix.vocabulary for x in tokens[k:e]):
                want.append((k, e - k))
        assert list(zip(starts.tolist(), lengths.tolist())) == want
        assert all(L._fold(t[a:b]) == x for x, (a, b) in zip(tokens, spans))


def test_cutting_out(spark):
    s = ". ".join(ITEMS[1])
    d = spark.createDataFrame([(1, f"Antes. {s}. Luego."), (2, "Nada."), (3, s)], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, s)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in L.without_spans(d, L.leaks(d, e)).collect()}
    assert got == {1: "Antes. . Luego.", 2: "Nada."}


def test_share_is_that_of_brute_force():
    ix = L.Index([(1, ". ".join(ITEMS[3]))])
    for k in range(1, 5):
        hits = list(ix.find(FILL[0] + ". " + ". ".join(ITEMS[3][:k])))
        share = sum(len(x.replace(" ", "")) for x in ITEMS[3][:k]) / sum(len(x.replace(" ", "")) for x in ITEMS[3])
        assert (len(hits) == 1 and abs(hits[0][1] - share) < 0.02) if share >= L.SHARE else not hits
