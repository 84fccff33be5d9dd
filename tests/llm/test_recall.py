"""Recall and precision on cases planted into the test tables' own rows."""

import random

from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F
from verbena.llm import leakage as L
from verbena.llm import sentences as S
from verbena.llm.names import map_names
from verbena.llm.ocr import Scans


def scores(found, true):
    found, true = set(found), set(true)
    both = len(found & true)
    return both / max(1, len(true)), both / max(1, len(found))


def test_typed_names(spark):
    """Slips, lost marks, authors and abbreviations of listed names lead back to them; invented names to none."""
    rnd = random.Random(7)
    ref = spark.read.parquet(f"{SMALL}/species_reference.parquet").select("ref_id", "species", "synonyms").filter("species is not null")
    listed = [(r.ref_id, r.species) for r in ref.collect()]
    rows, true = [], []
    for i, (ref_id, name) in enumerate(rnd.sample(listed, 400)):
        genus, epithet = name.split()[:2]
        k = rnd.randrange(2, len(epithet) - 1)
        typed = rnd.choice([name.upper(), f"{genus} {epithet[:k]}{epithet[k + 1:]}", f"{genus} {epithet[:k]}{epithet[k]}{epithet[k:]}", f"{genus} {epithet[: k - 1]}{epithet[k]}{epithet[k - 1]}{epithet[k + 1:]}", f"{genus} cf. {epithet}", f"{genus} {epithet} var. alba", f"{epithet}, {genus}", f"{genus}  {epithet} L."])
        rows.append(("t", i, typed))
        true.append((i, ref_id))
    word = lambda n: "".join(rnd.choice("qwxkzj") + rnd.choice("aeiou") for _ in range(n)).capitalize()
    for i in range(400, 500):
        rows.append(("t", i, f"{word(4)} {word(5).lower()}"))
        true.append((i, 0))
    got = map_names(spark.createDataFrame(rows, "src_table string, row_id bigint, name string"), ref)
    recall, precision = scores(((r.row_id, r.ref_id) for r in got.select("row_id", F.coalesce("ref_id", F.lit(0)).alias("ref_id")).collect()), [(i, r) for i, r in true if not any(x[1] == i and x[2] in {n for _, n in listed} for x in rows)])
    assert recall > 0.97 and precision > 0.97


def test_noise_of_scans(spark):
    """Noise put into the clean texts is found by kind, and only it."""
    rnd = random.Random(3)
    t = spark.read.parquet(f"{MEDIUM}/picked_species_enhanced.parquet")
    texts = [(r.pick_id, r.habitat_raw) for r in t.filter("habitat_raw is not null").collect()]
    first = Scans(spark.createDataFrame([(i, "f", x) for i, x in texts], "row_id bigint, field_name string, text string"))
    noisy = {r.row_id for r in first.noise().collect()}
    clean = {r.row_id: r.text for r in first.paragraphs().collect() if r.row_id not in noisy}
    assert len(clean) > 100
    planted, true = [], []
    for i, (row, text) in enumerate(sorted(clean.items())):
        words = text.split(" ")
        at = [k for k, w in enumerate(words[1:-1], 1) if w.isalpha() and w.islower() and len(w) > 6]
        kind = ("none", "line_hyphen", "misread", "header", "page_number")[i % 5]
        if kind == "line_hyphen" and at:
            k = rnd.choice(at)
            words[k] = words[k][:3] + "-\n" + words[k][3:]
        elif kind == "misread" and any("o" in words[k] for k in at):
            k = rnd.choice([k for k in at if "o" in words[k]])
            words[k] = words[k].replace("o", "0", 1)
        elif kind == "header":
            words[3] = words[3] + "\nFLORA DE PRUEBA\n"
        elif kind == "page_number":
            words[3] = words[3] + "\n[417]\n"
        else:
            kind = "none"
        if kind != "none":
            true.append((row, kind))
        planted.append((row, "f", " ".join(words)))
    rest = [(10_000_000 + i, "f", x) for i, x in texts]  # the corpus that the words are known from
    s = Scans(spark.createDataFrame(planted + rest, "row_id bigint, field_name string, text string"))
    recall, precision = scores(((r.row_id, r.noise) for r in s.noise().collect() if r.row_id < 10_000_000), true)
    assert recall > 0.97 and precision > 0.97
    back = {r.row_id: r.text for r in s.paragraphs().collect() if r.row_id < 10_000_000}
    assert sum(back[i] == " ".join(x.split()) for i, x in clean.items()) > 0.97 * len(clean)


def test_leaked_items(spark):
    """Items put into documents, whole, in part or with slips, are found; halves are not."""
    rnd = random.Random(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/eval_items.parquet").collect()]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    before = {(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()}
    long = [(i, t) for i, t in items if len(t.split()) > 30]
    planted, true = [], set(before)
    for k, (doc, text) in enumerate(docs):
        item, t = rnd.choice(long)
        words = t.split()
        kind = k % 4
        if kind == 0:
            passage = t.upper()
        elif kind == 1:
            passage = " ".join(words[: int(0.8 * len(words))])
        elif kind == 2:
            passage = " ".join("otra" if n % 11 == 5 else w for n, w in enumerate(words))
        else:
            passage = " ".join(words[: int(0.35 * len(words))])
        cut = text.find(" ", len(text) // 2)
        planted.append((doc, text[:cut] + "\n\n" + passage + "\n\n" + text[cut:]))
        if kind < 3:
            true.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(planted, "doc_id bigint, text string"), e).collect()}
    recall, precision = scores(got, true)
    assert recall > 0.95 and precision > 0.95


def test_sentence_boundaries(spark):
    """Known sentences with abbreviations, figures and quotations, put together anew, are told apart again."""
    from test_sentences import CASES

    d = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    st = S.statistics(d)
    sp = S.Splitter(st, S.fit(d, st))
    rnd = random.Random(2)
    found, true = [], []
    for i in range(200):
        units = [u for case in rnd.sample(CASES, 3) for u in case]
        text, at = rnd.choice([" ", "\n"]).join(units), 0
        for u in units:
            true.append((i, at, at + len(u)))
            at += len(u) + 1
        found += [(i, s, e) for s, e in sp.units(text)]
    recall, precision = scores(found, true)
    assert recall > 0.97 and precision > 0.97
