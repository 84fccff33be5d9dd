"""Repair text that still carries the scanned page it came from.

1. Edge lines. A line is a running head if its words, without digits and case, come back as a whole
   line that interrupts the text, in a fair share of all occurrences of its rarest word. Heads are met word
   by word in a table of their first words (or, where they are too many to broadcast, by a join on their
   rarest words) and are cut with the page numbers, also where the line breaks are gone.
2. Hyphens. A word cut before white space is joined, unless the text's own vocabulary knows the pair as
   a compound, or a capital follows. A height cut after its hyphen is joined and keeps it.
3. Misread characters. Every word has an anagram hash, the sum of its characters' values; reading a
   character wrongly adds a known difference. Words join the far more frequent words that lie one or two
   differences away in SQL, the swaps are verified at their places, and the correction with the fewest
   differences, then the most frequent, wins. Figures (heights) that hold letters join frequent figures in the
   same way, with the differences of all their letters at once. Differences of marks and figures among letters
   that are not in the list are learned from pairs of words that are equal but for them.
4. Paragraphs. Lines are joined; blank lines stay where a sentence ends before them and no head or page
   number was cut there.

Frequent words are a bounded set (a share of all words each) and are broadcast; rare words meet their
corrections in a shuffle that no frequent word enters. The texts are scanned once in the JVM (lines and words
in one aggregate) and once in Python.

Defined results: null or empty texts give no rows and stay as they are; a text without noise gives its
paragraphs unchanged but for white space; repeated rows give one row per kind; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, at_most, checked_join, materialise

# What scanners read for what.
CONFUSED = (
    ("c", "e"), ("v", "u"), ("b", "h"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("ii", "ú"), ("ii", "u"), ("ti", "ú"), ("fi", "ñ"), ("f", "í"), ("é", "ó"), ("é", "e"), ("0", "o"), ("1", "l"), ("1", "i"),
    ("5", "s"), ("8", "b"), ("@", "a"), ("4", "á"), ("4", "a"), ("6", "ó"), ("3", "e"), ("9", "g"), ("£", ""), ("d", "cl"), ("m", "rn"), ("n", "ri"), ("e", "c"), ("h", "b"), ("u", "v"), ("l", "i"), ("i", "l"), ("á", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ñ", "n"), ("1", "í"), ("0", "ó"), ("6", "o"),
)
# Letters that scanners read for figures.
FIGURES = (("O", "0"), ("o", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8"), ("Z", "2"))
#: How many times more frequent the right word must be, and the least share of all words it must have.
TIMES, SHARE = 10, 1e-5
#: Words that show a difference before it is learned, and least share of the words with the same wrong part.
SHOWN, SHOWN_SHARE = 5, 0.2
#: Differences that stand in the plan as an expression; where there are more, all are joined to the parts of words.
INLINE = 150
#: Least share of the occurrences of its rarest word that a head has as a line, and least number.
HEAD_SHARE, HEAD_LINES = 0.1, 4
#: Share of a head's lines that stand between other lines and that end without a stop.
HEAD_INSIDE = 0.9

_HYPHENS = "-¬­‐"
_DASHES = "-–—―−"
_H, _D = re.escape(_HYPHENS), re.escape(_DASHES)


class _Bases(dict):
    """Per character the first of its decomposition, looked up once."""

    def __missing__(self, c: int) -> int:
        self[c] = ord(unicodedata.normalize("NFD", chr(c))[0])
        return self[c]


_BASE_OF = _Bases()


def _plain(s: str) -> str:
    """Lower case without accents, character for character."""
    return s.lower().translate(_BASE_OF) if not s.isascii() else s.lower()


_LETTERS = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii() and unicodedata.normalize("NFD", chr(c))[0] != chr(c))
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _LETTERS)


def head_key(line: Column) -> Column:
    """A line's words without case, accents, figures (arabic and roman) and marks."""
    s = F.lower(F.translate(line, _LETTERS, _BASES))
    s = F.regexp_replace(F.regexp_replace(s, "(?<=[a-z])0|0(?=[a-z])", "o"), "(?<=[a-z])1|1(?=[a-z])", "l")
    s = F.regexp_replace(s, r"[^a-z]+", " ")
    return F.trim(F.regexp_replace(s, r"\b[ivxl]+\b|\bpag\b", " "))


def units(texts: DataFrame) -> DataFrame:
    """One row per distinct line key (kind l) and word (kind w) of all texts, with counts, in one scan. texts: (text)."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: F.length(x) > 0)
    ls = texts.select("text", lines.alias("ls"))

    def told(x: Column, i: Column) -> Column:
        key = F.trim(F.regexp_replace(head_key(x), " +", " "))
        after = F.coalesce(F.get("ls", i - 1), F.lit("")).rlike(f"[{_H}]$") & x.rlike(r"^\p{Ll}")
        return F.struct(F.lit("l").alias("kind"), key.alias("value"), x.alias("line"), ((i > 0) & (i < F.size("ls") - 1)).alias("inside"), (F.size("ls") > 1).alias("broken"), (x.rlike(rf"[.,;:){_H}]$") | after).alias("stop"))

    no = F.lit(False)
    word = lambda w: F.struct(F.lit("w").alias("kind"), w.alias("value"), F.lit(None).cast("string").alias("line"), no.alias("inside"), no.alias("broken"), no.alias("stop"))
    words = F.split(F.lower("text"), r"[\s,.;:()\[\]\"—–]+")
    at = ls.select(F.explode(F.concat(F.transform("ls", told), F.transform(words, word))).alias("t")).select("t.*").filter("value <> ''")
    broken = F.col("broken")
    return at.groupBy("kind", "value").agg(F.count("*").alias("n"), F.count_if(broken).alias("lines"), F.count_if(broken & F.col("inside")).alias("inside"), F.count_if(broken & ~F.col("stop")).alias("free"), F.min(F.when(broken, F.col("line"))).alias("line"))


def find_heads(units: DataFrame) -> DataFrame:
    """(key, rarest): keys of the running heads and of the parts of heads, with the rarest word of each."""
    lines = units.filter("kind = 'l'")
    words = lines.select("n", F.explode(F.array_distinct(F.split("value", " "))).alias("w")).groupBy("w").agg(F.sum("n").alias("c"))
    whole = lines.filter((F.col("lines") >= HEAD_LINES) & (F.col("inside") >= HEAD_INSIDE * F.col("lines")) & (F.col("free") >= HEAD_INSIDE * F.col("lines")))
    halves = F.transform(F.split("line", " [—–|] "), lambda x: F.trim(F.regexp_replace(head_key(x), " +", " ")))
    keys = whole.select("lines", F.explode(F.concat(F.array("value"), halves)).alias("key")).filter("key <> ''").groupBy("key").agg(F.max("lines").alias("lines"))
    rare = materialise(keys.select("key", "lines", F.explode(F.split("key", " ")).alias("w")), "ocr-lines").join(words, "w")
    rare = rare.groupBy("key", "lines").agg(F.min(F.struct("c", "w")).alias("r"))
    # At most 1 / HEAD_SHARE heads can share their rarest word, and each needs HEAD_LINES lines.
    return rare.filter(F.col("lines") >= HEAD_SHARE * F.col("r.c")).select("key", F.col("r.w").alias("rarest"))


_WORD = r"[^\W_]"
_PAGE_LINE = re.compile(rf"^[\s\[({_D}]*(?:p[aá]gs?\.?\s*|p\.\s*)?\d{{1,6}}[\s\]){_D}]*$", re.I)
_PAGE_INSIDE = re.compile(rf"(?<!{_WORD})p[aá]g\.\s*\d{{1,6}}(?!\d)|\[\d{{1,6}}\]|(?<![^\s])[{_D}] \d{{1,6}} [{_D}](?![^\s])", re.I)
_CUT = re.compile(rf"(?<![^\s{_H},.;:()])({_WORD}[^\s{_H},.;:()]*)([{_H}])(\s+|(?<=[¬­‐])(?={_WORD}))({_WORD}[^\s,.;:()]*)")
_CUT_HEIGHT = re.compile(rf"(?<=\d)([{_D}])[^\S\n]*(?:\n\s*|\s+(?=\d+\)?\s*m\b))(?=\d)")
_FIGURE = re.compile(r"(?<![^\W_])(?:[0-9OoSlIBZ]*[0-9][0-9OoSlIBZ]*(?![^\W_])|[OSlIBZ]{1,4}(?=[-–]\d))|(?<=\d[-–])[OSlIBZ]{1,4}(?![^\W_])")
_TOKEN = re.compile(r"[^\s,.;:()\[\]\"“”—–]+")
_FLAT = re.compile(r"[a-z0-9]+")
_LETTER_OF = str.maketrans("01", "ol")
_MIXED = re.compile(r"[a-z][01]|[01][a-z]")
_ROMAN = re.compile(r"[ivxl]+\Z")
#: Stands for a piece that was cut out.
_GONE = "\x01"


def _head_words(flat: str) -> list[tuple[str, int, int]]:
    """Words of a flattened text with figures read as letters among letters; figures alone and roman numbers are left out."""
    out = []
    for m in _FLAT.finditer(flat):
        w = m.group()
        if w.isdigit() or _ROMAN.match(w) or w == "pag":
            continue
        if not w.isalpha():
            w = w.translate(_LETTER_OF)
        if w.isalpha():
            out.append((w, m.start(), m.end()))
    return out


class Pages:
    """Cuts heads and page numbers and joins cut words. ``compounds``: lower-case words that keep their hyphen; ``known``: frequent words."""

    def __init__(self, heads: list[str], compounds: set[str], known: set[str]):
        self.heads = self.by_first(heads)
        self.compounds, self.known = compounds, known
        self.tails = {c.split("-")[-1] for c in compounds}

    @staticmethod
    def by_first(heads: list[str]) -> dict[str, list[list[str]]]:
        """Heads by their first word, longest first."""
        out: dict[str, list[list[str]]] = {}
        for words in sorted((h.split() for h in heads), key=len, reverse=True):
            out.setdefault(words[0], []).append(words)
        return out

    def _heads(self, text: str, more: list[str] | None) -> list[tuple[int, int]]:
        heads = self.heads if more is None else self.by_first(list(more))
        if not heads:
            return []
        flat = _plain(text)
        if len(flat) != len(text):
            return []
        tokens = _FLAT.findall(flat)
        if heads.keys().isdisjoint(tokens) and not (_MIXED.search(flat) and any(t.translate(_LETTER_OF) in heads for t in tokens)):  # no head can begin
            return []
        out, words, i = [], _head_words(flat), 0
        while i < len(words):
            step = 1
            for head in heads.get(words[i][0], ()):
                n = len(head)
                if [w for w, _, _ in words[i : i + n]] == head and all("\n" not in text[a[2] : b[1]] and b[1] - a[2] < 20 for a, b in zip(words[i : i + n - 1], words[i + 1 : i + n])):
                    s, e = words[i][1], words[i + n - 1][2]
                    e += len(m.group()) if (m := re.match(r"[.,]?\s*[ivxl]+(?![a-z0-9])", flat[e : e + 12])) else 0
                    raw = text[s:e]
                    if " " in raw.strip() and raw[:1].isupper() or sum(c.isupper() for c in raw) > 0.7 * sum(c.isalpha() for c in raw):
                        out.append((s, e))
                        step = n
                        break
            i += step
        return out

    def cut(self, text: str, heads: list[str] | None = None) -> tuple[str, bool, bool]:
        """The text with _GONE for heads and page numbers; whether it had any. ``heads``: those of this text, if not all are known here."""
        head = page = False
        out = text.replace(_GONE, " ")
        if "\n" in out:
            lines = [_GONE if _PAGE_LINE.match(line) else line for line in out.split("\n")]
            page = _GONE in lines
            out = "\n".join(lines)
        for s, e in reversed(self._heads(out, heads)):
            before = re.search(rf"(?<![\w{_D}(])\d{{1,6}}[^\S\n]*[{_D}][^\S\n]*$", out[max(0, s - 40) : s])
            after = re.match(rf"[^\S\n]*[{_D}]?[^\S\n]+\d{{1,6}}(?![\d\w({_D}])(?!\s*m\b)(?!, [A-Z]{{2,}})", out[e : e + 60])
            head = True
            if before:
                s, page = s - len(before.group()), True
            elif after:
                e, page = e + after.end(), True
            out = out[:s] + _GONE + out[e:]
        out, n = _PAGE_INSIDE.subn(_GONE, out)
        return out, head, page or n > 0

    def join(self, text: str) -> tuple[str, int]:
        """The text with cut words joined, and how many were."""
        n = 0

        def one(m: re.Match) -> str:
            nonlocal n
            a, mark, gap, b = m.groups()
            low, tail = f"{a}-{b}".lower(), b.lower()
            if not b[0].islower() and not b[0].isdigit() and b[0] not in "@":
                return f"{a}-{b}"
            if b[0].isdigit() and not any(c.isalpha() for c in b):
                return m.group()  # heights are joined before
            if mark == "-" and (low in self.compounds or tail in self.tails and (a + b).lower() not in self.known and len(a) > 3):
                return f"{a}-{b}"
            n += 1
            return a + b

        last = None
        while last != text:  # overlapping cuts
            last, text = text, _CUT.sub(one, text) if any(h in text for h in _HYPHENS) else text
        return text, n

    def repair(self, text: str, heads: list[str] | None = None) -> tuple[str, bool, bool, int]:
        out, head, page = self.cut(text, heads)
        out = re.sub(rf"\s*{_GONE}[\s{_GONE}]*", "\n", out)
        out, n = self.join(_CUT_HEIGHT.sub(r"\1", out))
        parts = re.split(r"(?<=[.!?…:)”»\"])[^\S\n]*\n[^\S\n]*\n\s*", out)
        return "\n\n".join(p for p in (re.sub(r"\s+", " ", x).strip() for x in parts) if p), head, page, n


def words_of(text: str) -> list[str]:
    return [t.strip(_HYPHENS) for t in _TOKEN.findall(text)]


def figures_of(text: str) -> list[str]:
    """Figures, and tokens that may be figures with misread characters."""
    return _FIGURE.findall(text)


def anagram(word: Column) -> Column:
    """Sum of the fifth powers of the characters' places among 200 (so that different bags of characters seldom agree)."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c: F.pow(F.pmod(F.ascii(c), F.lit(400)).cast("double"), F.lit(5.0)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def anagram_of(text: str) -> int:
    return sum((ord(c) % 400) ** 5 for c in text)


def _swapped(word: Column, wrong: Column, good: Column) -> Column:
    """All strings in which one ``wrong`` of word is read as ``good``."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda p: F.substring(word, p, F.length(wrong)) == wrong)
    return F.transform(at, lambda p: F.concat(F.substring(word, F.lit(1), p - 1), good, F.substring(word, p + F.length(wrong), F.length(word))))


def _rules(rules: list[tuple[str, str]], suffix: str = "") -> Column:
    """The differences as an array (wrong, good, delta)."""
    rows = ", ".join(f"named_struct('wrong{suffix}', {_quoted(w)}, 'good{suffix}', {_quoted(g)}, 'delta{suffix}', {anagram_of(g) - anagram_of(w)}L)" for w, g in rules)
    return F.expr(f"array({rows})")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(text: Column) -> Column:
    """The distinct parts of one and two characters, which wrong parts are."""
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda p: F.substring(text, p, F.lit(k)))
    return F.array_distinct(F.concat(cut(1), cut(2)))


def _with_rules(df: DataFrame, texts: list[Column], rules: DataFrame, suffix: str = "") -> DataFrame:
    """df with each difference (wrong, good, delta) whose wrong part stands in one of the texts. rules: a written table of (wrong, good)."""
    names = [f"{c}{suffix}" for c in ("wrong", "good", "delta")]
    if at_most(rules, INLINE):
        given = sorted((r.wrong, r.good) for r in rules.collect())
        held = F.filter(_rules(given, suffix), lambda r: reduce(or_, (F.instr(t, r[names[0]]) > 0 for t in texts)))
        return df.select("*", F.explode(held).alias("r")).select(*df.columns, *(f"r.{c}" for c in names))
    delta = anagram(F.col("good")) - anagram(F.col("wrong"))
    told = rules.select(F.col("wrong").alias(names[0]), F.col("good").alias(names[1]), delta.alias(names[2]))
    cut = df.select("*", F.explode(F.array_distinct(F.concat(*map(_parts, texts)))).alias(names[0]))
    return checked_join(cut, told, [names[0]], salt_on=["word"]).select(*df.columns, *names)


def learned(rare: DataFrame, right: DataFrame) -> DataFrame:
    """(wrong, good): differences of marks and figures among letters: parts of rare words (word) beside parts of frequent words (right) that are equal but for them."""
    def gapped(word: str, sizes: range, odd: bool) -> Column:
        w = F.col(word)
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - k + 1, F.lit(1))), lambda p: F.struct(F.concat(F.substring(w, F.lit(1), p - 1), F.lit("\x00"), F.substring(w, p + k, F.length(w))).alias("rest"), F.substring(w, p, F.lit(k)).alias("part")))
        every = F.array_distinct(F.concat(*map(cut, sizes)))
        return F.filter(every, lambda x: x["rest"].rlike("^[\\p{L}-]*\x00[\\p{L}-]*$") & (x["part"].rlike(r"[^\p{L}-]") if odd else F.lit(True)))

    odd = rare.filter(F.col("word").rlike(r"[^\p{L}-]") & (F.length("word") >= 5))
    a = odd.select("word", F.explode(gapped("word", range(1, 3), True)).alias("g")).select("word", "g.rest", F.col("g.part").alias("wrong"))
    b = right.filter(F.length("right") >= 4).select(F.explode(gapped("right", range(0, 3), False)).alias("g")).select("g.rest", F.col("g.part").alias("good"))
    a = materialise(a, "ocr-odd")
    shown = a.join(b.distinct(), "rest").groupBy("wrong", "good").agg(F.countDistinct("word").alias("n"))
    total = a.groupBy("wrong").agg(F.countDistinct("word").alias("total"))
    best = shown.join(total, "wrong").filter((F.col("n") >= SHOWN) & (F.col("n") >= SHOWN_SHARE * F.col("total")))
    return best.select("wrong", "good")


def corrections(counts: DataFrame) -> DataFrame:
    """counts (word, n) -> (word, right): ranked corrections of rare words into frequent ones."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.filter("length(word) > 1")
    frequent = counts.filter(F.col("n") >= max(5.0, SHARE * total)).filter(F.col("word").rlike(r"^[\p{L}-]+$"))
    right = materialise(frequent.select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram(F.col("word")).alias("hash")), "ocr-frequent")
    most = right.agg(F.max("right_n")).first()[0] or 0
    base = counts.filter(F.col("n") * TIMES <= most).select("word", "n", anagram(F.col("word")).alias("h0"))
    fixed = base.sparkSession.createDataFrame(list(CONFUSED), "wrong string, good string")
    rules = materialise(fixed.unionByName(learned(base, right)).distinct(), "ocr-rules")
    one = _with_rules(base, [F.col("word")], rules).select("word", "n", "wrong", "good", (F.col("h0") + F.col("delta")).alias("hash"))
    changed = F.replace("word", F.col("wrong"), F.col("good"))
    two = _with_rules(one, [F.col("word"), changed], rules, "2").select("word", "n", "wrong", "good", (F.col("hash") + F.col("delta2")).alias("hash"), "wrong2", "good2")
    none = F.lit(None).cast("string")
    tried = one.select("word", "n", "hash", "wrong", "good", none.alias("wrong2"), none.alias("good2")).unionByName(two.select("word", "n", "hash", "wrong", "good", "wrong2", "good2"))
    met = checked_join(tried, right, ["hash"], salt_on=["word"]).filter((F.col("n") * TIMES <= F.col("right_n")) & (F.col("word") != F.col("right")))
    first = _swapped(F.col("word"), F.col("wrong"), F.col("good"))
    fits = F.when(F.col("wrong2").isNull(), F.array_contains(first, F.col("right"))).otherwise(F.exists(first, lambda m: F.array_contains(_swapped(m, F.col("wrong2"), F.col("good2")), F.col("right"))))
    steps = F.when(F.col("wrong2").isNull(), 1).otherwise(2)
    best = materialise(met.filter(fits).groupBy("word").agg(F.min_by("right", F.struct(steps, -F.col("right_n"), "right")).alias("right")), "ocr-best")
    again = best.select(F.col("word").alias("right"), F.col("right").alias("further"))  # the right word may be a frequent misreading itself
    return best.join(again, "right", "left").select("word", F.coalesce("further", "right").alias("right"))


def figure_corrections(counts: DataFrame) -> DataFrame:
    """counts (word, n) of figures -> (word, right): those with letters into figures that occur at least as often."""
    right = counts.filter(F.col("word").rlike("^[0-9]+$")).select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram(F.col("word")).alias("hash"))
    odd = counts.filter(F.col("word").rlike("[^0-9]"))
    times = lambda c: F.length("word") - F.length(F.replace("word", F.lit(c), F.lit("")))
    moved = sum((times(w) * F.lit(anagram_of(g) - anagram_of(w)) for w, g in FIGURES), anagram(F.col("word")))
    met = odd.withColumn("hash", moved).join(right, "hash").filter("right_n >= n")
    read = F.translate("word", "".join(w for w, _ in FIGURES), "".join(g for _, g in FIGURES))
    return met.filter(read == F.col("right")).select("word", "right")


class Scans:
    """texts: (row_id, field_name, text); row_id and field_name name a text."""

    def __init__(self, texts: DataFrame, broadcast_rows: int = BROADCAST_ROWS):
        texts = texts.filter("text is not null and trim(text) <> ''").select("row_id", "field_name", "text")
        found = materialise(units(texts), "ocr-units")
        heads = materialise(find_heads(found), "ocr-heads")
        few = at_most(heads, broadcast_rows)
        self.heads = sorted(r.key for r in heads.collect()) if few else None
        raw = found.filter("kind = 'w'").select(F.col("value").alias("word"), "n")
        total = raw.agg(F.sum("n")).first()[0] or 0
        least = max(5.0, SHARE * total)  # at most 1 / SHARE such words
        known = raw.filter((F.col("n") >= least) & F.col("word").rlike(r"^\p{L}+(-\p{L}+)*$")).collect()
        spark = texts.sparkSession
        compounds = {r.word for r in known if "-" in r.word}
        pages = spark.sparkContext.broadcast(Pages(self.heads or [], compounds, {r.word for r in known if "-" not in r.word}))
        texts = texts.withColumn("heads", F.lit(None).cast("array<string>")) if few else self._with_heads(texts, heads)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = pages.value
            for pdf in batches:
                rows = []
                for i, f, t, h in zip(pdf["row_id"], pdf["field_name"], pdf["text"], pdf["heads"]):
                    out, head, page, cuts = p.repair(t, h)
                    rows.append((i, f, out, head, page, cuts > 0, figures_of(out), words_of(out)))
                yield pd.DataFrame(rows, columns=["row_id", "field_name", "text", "header", "page_number", "line_hyphen", "figures", "words"])

        schema = "row_id bigint, field_name string, text string, header boolean, page_number boolean, line_hyphen boolean, figures array<string>, words array<string>"
        self.pages = materialise(texts.mapInPandas(run, schema), "ocr-pages")
        entry = lambda kind: lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word"))
        both = F.concat(F.transform(F.array_distinct(F.transform("words", F.lower)), entry("w")), F.transform(F.array_distinct("figures"), entry("f")))
        flat = self.pages.select("row_id", "field_name", F.explode(both).alias("t")).select("row_id", "field_name", "t.*").filter(F.col("word").rlike(r"[\p{L}\p{N}@£]") & ((F.col("kind") == "f") | F.col("word").rlike(r"\p{L}|[^\p{L}\p{N}-]")))
        counts = materialise(flat.groupBy("kind", "word").agg(F.count("*").alias("n")), "ocr-counts")
        of = lambda kind: counts.filter(F.col("kind") == kind).select("word", "n")
        wrong = corrections(of("w")).withColumn("kind", F.lit("w")).unionByName(figure_corrections(of("f")).withColumn("kind", F.lit("f")))
        self.fixes = materialise(wrong, "ocr-fixes")
        common = counts.join(self.fixes.select("kind", "word"), ["kind", "word"], "left_anti").filter(F.col("n") >= least).select("kind", "word")
        rest = flat
        if at_most(common, BROADCAST_ROWS):
            rest = flat.join(F.broadcast(common), ["kind", "word"], "left_anti")
        self.misread = materialise(checked_join(rest, self.fixes, ["kind", "word"], salt_on=["row_id", "field_name"]), "ocr-misread")

    @staticmethod
    def _with_heads(texts: DataFrame, heads: DataFrame) -> DataFrame:
        """Each text with the heads whose rarest word it holds: for more heads than can be broadcast."""
        words = F.array_distinct(F.filter(F.split(head_key(F.col("text")), " "), lambda w: F.length(w) > 0))
        met = checked_join(texts.select("row_id", "field_name", F.explode(words).alias("rarest")), heads, ["rarest"], salt_on=["row_id", "field_name"], max_rows=0)
        mine = met.groupBy("row_id", "field_name").agg(F.collect_set("key").alias("heads"))
        return texts.join(mine, ["row_id", "field_name"], "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))

    def noise(self) -> DataFrame:
        """(row_id, field_name, noise)."""
        kinds = F.array(*(F.when(F.col(c), F.lit(c)) for c in ("header", "page_number", "line_hyphen")))
        seen = self.pages.select("row_id", "field_name", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("noise"))
        return seen.unionByName(self.misread.select("row_id", "field_name", F.lit("misread").alias("noise"))).distinct()

    def paragraphs(self) -> DataFrame:
        """(row_id, field_name, text): continuous text with the corrections applied, capitals kept."""
        fix = self.misread.groupBy("row_id", "field_name").agg(F.collect_set(F.struct("kind", "word", "right")).alias("fixes"))
        both = self.pages.join(fix, ["row_id", "field_name"], "left")
        side = r"[\p{L}\p{N}@£]"

        def swap(acc: Column, x: Column) -> Column:
            sub = lambda text, flags, word, right: F.regexp_replace(text, F.concat(F.lit(rf"{flags}(?<!{side})\Q"), word, F.lit(rf"\E(?!{side})")), right)
            low = sub(sub(acc, "", x["word"], x["right"]), "", F.upper(x["word"]), F.upper(x["right"]))
            return F.when(x["kind"] == "f", sub(acc, "", x["word"], x["right"])).otherwise(sub(low, "(?iu)", x["word"], F.initcap(x["right"])))

        return both.select("row_id", "field_name", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(F.aggregate("fixes", F.col("text"), swap)).alias("text"))
