from conftest import rows
from verbena.llm.ocr import Pages, Scans

SCHEMA = "row_id bigint, field_name string, text string, word string, n int, words string, header string"
BASE = ["Bosque húmedo con laderas umbrías y claros naturales entre montañas", "Las semillas permanecen viables durante varias semanas de sequía prolongada", "sector centro-occidental de la cordillera, corredor Marbelo-Tarumá y llanos"]


def scans(spark, texts):
    base = [(1000 + i, "f", f"{BASE[i % 3]}, 400-1200 m.", None, 1, "w", None) for i in range(90)]
    heads = [(2000 + i, "f", f"Bosque húmedo con\nFLORA ANDINA\nladeras umbrías {i}.", None, 1, "w", None) for i in range(12)]
    data = [(i, "f", t, "x", 0, "y", "z") for i, t in enumerate(texts)]
    return Scans(spark.createDataFrame(data + base + heads, SCHEMA))


def test_kinds_of_noise_and_repair(spark):
    texts = [
        "Las semi-\nllas permanecen viables",  # 0
        "Las semi¬ llas permanecen viables",  # 1
        "sector centro-\noccidental, corredor Marbelo-\nTarumá, 400-\n1200 m",  # 2 none
        "Las sernillas permanecen viablcs",  # 3
        "Bosque húmedo, 4O0-1200 m y l00 m",  # 4
        "Bosque húmedo con\nFLORA ANDINA  12\nladeras umbrías",  # 5
        "Bosque húmedo con\n\n   [77]\nladeras umbrías",  # 6
        "Bosque húmedo FLORA ANDINA con laderas pág. 9 umbrías",  # 7
        None,
        "",
        "Bosque húmedo con laderas\numbrías",  # 10 none
        "Las semi-\nFLORA ANDINA\nllas permanecen",  # 11
        "Bosque húmedo " * 5_000,  # 12
        "Bo5que hiimedo con ladcras£",  # 13
    ]
    s = scans(spark, texts)
    assert s.heads == ["flora andina"]
    got = [(r.row_id, r.noise) for r in s.noise().collect() if r.row_id < 100]
    assert sorted(got) == sorted([(0, "line_hyphen"), (1, "line_hyphen"), (3, "misread"), (4, "misread"), (5, "header"), (5, "page_number"), (6, "page_number"), (7, "header"), (7, "page_number"), (11, "line_hyphen"), (11, "header"), (13, "misread")])
    text = {r.row_id: r.text for r in s.paragraphs().collect()}
    assert text[0] == text[1] == "Las semillas permanecen viables" == text[3]
    assert text[2] == "sector centro-occidental, corredor Marbelo-Tarumá, 400-1200 m"
    assert text[5] == text[6] == "Bosque húmedo con laderas umbrías" == text[10]
    assert text[7] == "Bosque húmedo con laderas umbrías" and text[11] == "Las semillas permanecen" and text[13] == "Bosque húmedo con laderas"
    assert text[4] == "Bosque húmedo, 400-1200 m y l00 m"  # no 100 anywhere to go by
    assert 8 not in text and 9 not in text


def noise_of(s):
    return sorted((r.row_id, r.noise) for r in s.noise().collect() if r.row_id < 100)


def test_heads_of_short_words_and_long_page_numbers(spark):
    texts = ["Bosque húmedo con\nEL SOL\nladeras umbrías"] * 12 + ["Bosque húmedo con\n12345\nladeras umbrías", "Bosque húmedo pág. 70123 con laderas", "Bosque EL SOL húmedo", "Bosque el sol húmedo"]
    s = scans(spark, texts)
    assert s.heads == ["el sol", "flora andina"]
    want = sorted([(i, "header") for i in range(12)] + [(12, "page_number"), (13, "page_number"), (14, "header")])
    assert noise_of(s) == want
    base = [(i, "f", t, "x", 0, "y", "z") for i, t in enumerate(texts)] + [(2000 + i, "f", f"Bosque húmedo con\nFLORA ANDINA\nladeras umbrías {i}.", None, 1, "w", None) for i in range(12)]
    many = Scans(spark.createDataFrame(base, SCHEMA), broadcast_rows=0)  # heads by a join
    assert many.heads is None and noise_of(many) == want


def test_figures_cut_heights_and_paragraphs(spark):
    texts = [
        "Sube de 4O0 a l2OO m y de I00 a 100 m",
        "entre 400–\n1200 m y 400- 1200 m",
        "Bosque húmedo.\n\nLas semillas permanecen\n\n[77]\n\nviables.\n \nLas semillas",
        "BOSQUE HÚMEDO, LADER4S y Sequí4 de laderas, lader4s",
    ]
    s = scans(spark, texts)
    text = {r.row_id: r.text for r in s.paragraphs().collect()}
    assert text[0] == "Sube de 400 a 1200 m y de 100 a 100 m"
    assert text[1] == "entre 400–1200 m y 400-1200 m"
    assert text[2] == "Bosque húmedo.\n\nLas semillas permanecen viables.\n\nLas semillas"
    assert text[3] == "BOSQUE HÚMEDO, LADERAS y Sequía de laderas, laderas"
    assert noise_of(s) == [(0, "misread"), (2, "page_number"), (3, "misread")]


def test_differences_are_learned(spark):
    s = scans(spark, ["Las se#illas per#anecen viables", "hú#edo #ontañas", "se#anas du#ante per#anecen"])
    fixes = {r.word: r.right for r in s.fixes.collect()}
    assert {fixes.get(w) for w in ("se#illas", "per#anecen", "hú#edo", "#ontañas", "se#anas")} == {"semillas", "permanecen", "húmedo", "montañas", "semanas"}
    assert "du#ante" not in fixes  # r for # was not shown often enough


def test_all_shown_differences_are_learned(spark, monkeypatch):
    """160 marks that each stand for m, of which no number is left out; in the plan or by a join."""
    from verbena.llm import ocr

    right = ["semillas", "montañas", "húmedo", "permanecen", "camino"]
    marks = [chr(0x2600 + i) for i in range(160)]
    data = [(w, 10_000) for w in right] + [(w.replace("m", m), 1) for w in right for m in marks]
    fixes = lambda given: {r.word: r.right for r in ocr.corrections(spark.createDataFrame(given, "word string, n bigint")).collect()}
    assert fixes(data) == {w.replace("m", m): w for w in right for m in marks}
    few = [*data[:5], *((w.replace("m", m), 1) for w in right for m in marks[:3]), ("sernillas", 2), ("rnontañ4s", 1), ("húrned0", 1), ("☀ontafias", 1)]
    inline = fixes(few)
    monkeypatch.setattr(ocr, "INLINE", 0)
    assert fixes(few) == inline and {w: inline.get(w) for w in ("sernillas", "rnontañ4s", "húrned0", "☀ontafias")} == {"sernillas": "semillas", "rnontañ4s": "montañas", "húrned0": "húmedo", "☀ontafias": "montañas"}


def test_what_is_found_is_repaired(spark):
    from conftest import MEDIUM
    from verbena.llm.q_ocr import _scans

    s = _scans(spark, MEDIUM)
    first = s.noise().groupBy("noise").count().collect()
    again = Scans(s.paragraphs()).noise().count()
    assert again <= 0.005 * sum(r["count"] for r in first)


def test_long_pieces_of_cut_words():
    word = "a" * 5_000
    assert Pages([], set(), set()).repair(f"uno {word}-\n{word} dos") == (f"uno {word}{word} dos", False, False, 1)
    assert Pages([], set(), set()).repair("x" * 300_000)[0] == "x" * 300_000


def test_empty_and_repeated(spark):
    assert Scans(spark.createDataFrame([], SCHEMA)).noise().count() == 0
    s = Scans(spark.createDataFrame([(1, "f", "pág. 3 a\nb", "", 0, "", "")] * 3, SCHEMA))
    assert rows(s.noise()) == [("f", "page_number", 1)]


def test_page_numbers_are_not_heights():
    p = Pages([], set(), set())
    assert p.cut("sube a 1200-1500 m") == ("sube a 1200-1500 m", False, False)
    assert p.cut("a\n  - 12 -\nb")[1:] == (False, True) and p.cut("a - 12 - b")[1:] == (False, True)
    assert p.cut("(Tarsán 512, YUM)")[2] is False
