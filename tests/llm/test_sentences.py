import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from verbena.llm import sentences as S


@pytest.fixture(scope="module")
def splitter(spark):
    d = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    st = S.statistics(d)
    return S.Splitter(st, S.fit(d, st))


def cut(splitter, text):
    return [text[s:e] for s, e in splitter.units(text)]


CASES = [
    ["La Dra. Tarsán revisó 35 láminas y descartó que fueran M. lasiulacincta o una sp. afín.", "Salieron a las 8 p. m.", "Velbrán seguía bajo la neblina."],
    ["La muestra pesaba 28,7 g.", "54 días después pesaba menos de la mitad."],
    ["Se midió en jun. y set.", "Luego el sendero de Ibrujo quedó cerrado por 11 días."],
    ["«¿Dónde la vio usted?», preguntó la guía al volver de Itzapé.", "«No la corten todavía.»", "Eso pidió la guía."],
    ["We met at 6 a.m.", "The ridge above Jorumbé was still dark.", '"Is that the one from Tarumá?" asked the mule driver while pointing at the petioles.'],
    ["At 3:15 p.m. the warden said that the stilt roots looked narrow... but no photograph was taken.", "“Do not pick it.”", "That is all the warden wrote about Tapirón."],
    ["Das Gebiet misst 18,4 ha usw.", "Mehr ist über Tolorá nicht bekannt.", "Dr. Pandolé hielt sie für P. albibrepetala, d. h. für eine andere Art."],
    ["El 3.er conteo, hecho por la U. N. de Tapirón, dio 1.860 individuos… pero el vaquiano no lo firmó.", "¡Qué olor deja al cortarla!"],
]


@pytest.mark.parametrize("units", CASES)
def test_latin(splitter, units):
    assert cut(splitter, " ".join(units)) == units
    assert cut(splitter, "  \n".join(units)) == units


def test_other_scripts(splitter):
    ja = ["「これはSirapaの株ですか。」と案内人が尋ねた。", "「採らないでください。」", "管理人はそれだけを書き残した。"]
    zh = ["守林人问道：「这是Ucrín的那一株吗？」", "2013年，守林人在旧牧场里数到42株幼苗，其中7株已经枯萎。", "“请不要采摘。”", "向导只留下这句话。"]
    hi = ['"क्या यह Velbrán वाला पौधा है?" वनरक्षक ने पूछा।', "डॉ. Fosbel ने 1936 में 48 नमूने जमा किए।", "क्या यह पौधा सूखे मौसम में दिखता है?"]
    for units, sep in ((ja, ""), (zh, ""), (hi, " ")):
        assert cut(splitter, sep.join(units)) == units
    th = ["พืชชนิดนี้ขึ้นในทุ่งหญ้าเก่าที่ความสูง 2170 เมตร", "ดอกของ Quelquirasia venoatrigyna บานในฤดูฝน", "ยังไม่มีใครเก็บผลของต้นนี้"]
    assert cut(splitter, " ".join(th)) == th


def test_blocks(splitter):
    text = "Hábitat y altitud\n\nCrece aquí. Florece en\nmayo.\n\n- uno. Dos\n- tres\n\n1) cuatro\n2) cinco"
    assert cut(splitter, text) == ["Hábitat y altitud", "Crece aquí.", "Florece en\nmayo.", "- uno. Dos", "- tres", "1) cuatro", "2) cinco"]


def test_units_cover_all_text(spark):
    d = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in d.collect()}
    places = {}
    for r in S.sentences(d).collect():
        places.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for doc, t in text.items():
        units = sorted(places.get(doc, []))
        assert all(a[1] <= b[0] for a, b in zip(units, units[1:]))
        assert all(t[s:e] == t[s:e].strip() != "" for s, e in units)
        assert "".join(t[s:e] for s, e in units).replace(" ", "").replace("\n", "") .split() == "".join(t.split()).split()


def test_nulls_empty_long_and_no_training(spark):
    schema = "doc_id bigint, text string, h bigint, n int"
    assert S.sentences(spark.createDataFrame([], schema)).count() == 0
    data = [(1, None, 0, 0), (2, "", 0, 0), (3, " \n ", 0, 0), (4, "Uno. Dos.", 0, 0), (4, "Uno. Dos.", 0, 0), (5, "palabra " * 40_000, 0, 0), (6, "... !!! ???", 0, 0)]
    got = [(r.doc_id, r.start_char, r.end_char) for r in S.sentences(spark.createDataFrame(data, schema)).collect()]
    assert sorted(x for x in got if x[0] == 4) == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert [x for x in got if x[0] == 5] == [(5, 0, 40_000 * 8 - 1)] and not [x for x in got if x[0] < 4]


def test_fit_does_not_depend_on_partitions(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one, many = d.repartition(1), d.repartition(16)
    a, b = S.statistics(one), S.statistics(many)
    assert a.known == b.known and a.rate == b.rate
    assert np.array_equal(S.fit(one, a), S.fit(many, a))


def test_long_words(splitter):
    url = "http://a.b/" + "c.d/" * 3_000 + "fin"
    text = f"Está en {url}. Luego sigue. X{'x' * 20_000}. Otra vez."
    assert cut(splitter, text) == [f"Está en {url}.", "Luego sigue.", f"X{'x' * 20_000}.", "Otra vez."]
