"""Sentence units of texts in many languages and scripts.

A text falls into blocks at blank lines: lists (each marked line a unit), headings, and prose. In prose
every terminator with its closing quotation marks, and in Thai every space beside a Thai word, is a
candidate boundary; a maximum-entropy model decides on it by the tokens around it, their case, length,
figures and script. It learns from reliable boundaries: ends of blocks joined to the beginning of the next
one are boundaries; no boundary is what a small letter follows, a period after an abbreviation (frequent
before a period, next to never at a block's end) and a Thai space beside figures or foreign words.

Token statistics are counted exactly over all documents, in SQL; tokens that make up less than SHARE of their
kind are not told apart from unknown ones, so what is broadcast is bounded (1 / SHARE tokens a kind) and means
the same at every size. The model is fitted on the candidates of at most SAMPLE documents, those of the least
hashes, whatever the partitioning; a pattern weighs as much as it occurs, up to REPEATS. The texts are
read three times (statistics, sample, cutting), the ids once more, and nothing but token counts is shuffled.

Defined results: null and blank texts have no unit; units never hold outer white space and together hold
every other character; a text without any terminator is one unit per block; repeated documents each
give their units; an empty table gives an empty result; other columns are ignored; of a word of more than
LONGEST characters the nearest LONGEST count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Documents whose labelled candidates train the model.
SAMPLE = 6000
#: Most times that equal labelled candidates of the sample count in the fit.
REPEATS = 20
#: Slots of the weights, least share of its kind's tokens that a token has to be known, characters of a word.
WEIGHTS, SHARE, LONGEST = 1 << 16, 4e-6, 4096
#: Expected block ends of a token that has none before it counts as an abbreviation.
EXPECTED = 3.0

_ENDS = frozenset(".!?…。！？।॥؟۔｡\"'”»」』)’")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_BULLET = regex.compile(r"\s*(?:[-•*–·▪◦‣]|\p{N}{1,3}[.)）]|[①-⑳])\s+")
_TERMS = r".!?…。！？।॥؟۔｡"
_FULL = "。！？।॥؟۔｡"
_STOPS = "。।॥۔｡"
_CLOSERS = r"”»」』\"'’)\]›“》）"
_STOP = re.compile(rf"(?P<term>[{_TERMS}]+(?:[   ][!?]+)?)(?P<close>(?:[   ]?»|[{_CLOSERS}])*)")
_CLOSED = regex.compile(rf"(?P<term>[{_TERMS}]+)(?P<close>(?:\s{{0,2}}»|[{_CLOSERS}])+)")
_MORE = frozenset(("", ".", "!", "?", "…"))
_TH = "[\u0e01-\u0e3a\u0e40-\u0e5b]"
_THAI = re.compile(rf"(?<={_TH})\s+(?=\S)|(?<=\S)\s+(?={_TH})")
_TO_FOREIGN = regex.compile(r"(?<=\p{Thai})(\s+)(?=[«“\"¿¡(]?\p{Lu}\p{Ll}*(?:\s+[^\s\p{Thai}]+){3,}?[.!?…][”»\"]?(?:\s|$))")
_HAS_THAI = re.compile("[\u0e01-\u0e5b]")
_OPENERS = "«“„\"‘‚「『¿¡《（‹"
_ANY_STOP = re.compile(rf"[{_TERMS}]")
_SPACE = re.compile(r"\s*")
_GLUED = regex.compile(r"^.*\p{Ll}{2}[.!?…]+(?=\p{Lu})")
_NUMBER = regex.compile(r"^[\p{Nd}.,:/×–\-]*\p{Nd}[\p{Nd}.,:/×–\-]*$")
_ROMAN = regex.compile(r"^[IVXLC]+$")
_WORDS = re.compile(r"[^\W_](?:[^\W_]|['’]|[.,:](?=[^\W_]))*")
_SHORT = re.compile(r"(?<![^\W_])(?<![.,:'’])[^\W_]{1,4}(?![^\W_'’])")
_AFTER_NUMBER = re.compile(r"(?<![^\W_])\d(?:[\d.,:]*\d)?\s+([^\W_]{1,4})(?![^\W_'’])")
_CAPITAL = regex.compile(r"(?<![\p{L}\p{M}\p{N}_])\p{Lu}[\p{L}\p{M}\p{N}]*")
_CAPITAL_INSIDE = regex.compile(r"(?<=[\p{L}\p{N},;)\]»”]\s)\p{Lu}[\p{L}\p{M}\p{N}]*")
_TRIM = "([{«“„\"'‘‚「『¿¡《（‹—–-"


@dataclass(slots=True)
class Block:
    start: int
    end: int
    kind: str  # prose, line


def blocks(text: str) -> Iterator[Block]:
    at = 0
    bounds = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    for s, e in bounds:
        body = text[at:s]
        if body.strip():
            lines = body.split("\n")
            if _BULLET.match(lines[0]):
                pos, first = at, None
                for line in lines:
                    if _BULLET.match(line) and first is not None:
                        yield Block(first, pos, "line")
                        first = pos
                    elif first is None:
                        first = pos
                    pos += len(line) + 1
                yield Block(first, s, "line")
            elif "\n" not in body and not _ANY_STOP.search(body) and not _HAS_THAI.search(body):
                yield Block(at, s, "line")
            else:
                yield Block(at, s, "prose")
        at = e


@dataclass(slots=True)
class Candidate:
    end: int  # after the closing marks
    word: str  # before the terminator
    before: str  # token before it
    term: str
    close: str
    gap: bool
    tail: str  # the token that follows, and the character after it
    foreign: bool = False  # a sentence in another script follows


_NEXT = re.compile(rf"\S{{1,{LONGEST}}}\s*\S?")


def _tail(text: str, at: int, hi: int) -> str:
    m = _NEXT.match(text, at, hi)
    return m.group() if m else ""


def _left(text: str, lo: int, at: int) -> tuple[str, str]:
    """The word before a place and the token before it."""
    if at <= lo or text[at - 1].isspace():
        return "", ""
    size = 64
    while True:
        start = max(lo, at - size)
        got = text[start:at].rsplit(None, 2)
        if start == lo or len(got) > 2 or size >= 2 * LONGEST:
            break
        size *= 4
    got[-1] = got[-1][-LONGEST:]
    word = got[-1].lstrip(_TRIM)
    if "." in word or "!" in word or "?" in word:
        word = _GLUED.sub("", word)
    return word, got[-2] if len(got) > 1 else ""


def _closing(text: str, lo: int, m: regex.Match) -> tuple[str, int]:
    """The marks that close after a terminator, and their end: a straight mark or “ closes only what stands open."""
    close, at = m["close"], m.start("close")
    for k, c in enumerate(close):
        if c == '"' and text.count('"', lo, at + k) % 2 == 0 or c == "“" and text.count("„", lo, at) <= text.count("“", lo, at + k):
            close = close[:k].rstrip()
            break
    return close, at + len(close)


def candidates(text: str, block: Block) -> Iterator[Candidate]:
    lo, hi = block.start, block.end
    for m in _STOP.finditer(text, lo, hi):
        close, end = _closing(text, lo, m) if m["close"] else ("", m.end("term"))
        start = _SPACE.match(text, end, hi).end()
        if start >= hi:
            continue
        nxt = text[start]
        gap = start > end
        if nxt in ",;:)]）、，；：.%":
            continue
        term = m["term"]
        loose = not gap and term[-1] not in _FULL
        if loose and not (nxt.isupper() or nxt in _OPENERS):
            continue
        word, before = _left(text, lo, m.start())
        if loose:
            if "." in word or (len(word) < 2 and not close) or not (word[-1:].islower() or word[-1:].isdigit() or close or term[-1] in "!?…"):
                continue
            if word[-1:].isdigit() and nxt.isupper() and not close and term == "." and len(word) < 3:
                continue
        yield Candidate(end, word, before, term, close, gap, _tail(text, start, hi))
    if _HAS_THAI.search(text, lo, hi):
        foreign = {m.start() for m in _TO_FOREIGN.finditer(text, lo, hi)}
        for m in _THAI.finditer(text, lo, hi):
            if text[m.start() - 1] not in _ENDS:  # a terminator is a candidate of its own
                yield Candidate(m.start(), text[max(lo, m.start() - 4) : m.start()], "", "", "", True, _tail(text, m.end(), hi), m.start() in foreign)


#: What stands between two blocks that are counted as one text.
_PART = "\n\x00\n"


class Counts:
    """Token counts of prose: kinds are stop, stop_end, all, after_number, cap, cap_inside, cluster, cluster_end."""

    KINDS = ("stop", "stop_end", "all", "after_number", "cap", "cap_inside", "cluster", "cluster_end")

    def __init__(self) -> None:
        self.n = {k: Counter() for k in self.KINDS}
        self.bodies: list[str] = []
        self.size = 0

    def add(self, text: str) -> None:
        for b in blocks(text):
            if b.kind == "prose":
                self.bodies.append(text[b.start : b.end].strip())
                self.size += b.end - b.start
        if self.size > 1_000_000:
            self.flush()

    def flush(self) -> None:
        """Counts the collected blocks all at once: each pattern runs over them as one text."""
        n, bodies = self.n, self.bodies
        self.bodies, self.size = [], 0
        if not bodies:
            return
        whole = _PART.join(bodies)
        n["all"].update(_SHORT.findall(whole))
        n["after_number"].update(_AFTER_NUMBER.findall(whole))
        n["cap"].update(_CAPITAL.findall(whole))
        n["cap_inside"].update(_CAPITAL_INSIDE.findall(whole))
        words = whole.split()
        n["stop"].update(w[:-1].lstrip(_TRIM) for w in words if w[-1] == "." and w[-2:-1] not in _MORE)
        ends = [body.rsplit(None, 1)[-1] for body in bodies]
        n["stop_end"].update(w[:-1].lstrip(_TRIM) for w in ends if w[-1] == "." and w[-2:-1] not in _MORE)
        for body in bodies:
            for m in _CLOSED.finditer(body):
                close, at = _closing(body, 0, m)
                if close:
                    key = f"{m['term'][-1]}{close}|{script(body[m.start() - 1 : m.start()])}"
                    n["cluster"][key] += 1
                    n["cluster_end"][key] += at >= len(body)

    def rows(self) -> list[tuple[str, str, int]]:
        self.flush()
        return [(kind, token, c) for kind, counter in self.n.items() for token, c in counter.items()]

    def __len__(self) -> int:
        return sum(map(len, self.n.values()))


_SCRIPTS = tuple((name, regex.compile(pat)) for name, pat in (("latin", r"\p{Latin}"), ("han", r"\p{Han}"), ("hira", r"\p{Hiragana}"), ("kata", r"\p{Katakana}"), ("thai", r"\p{Thai}"), ("deva", r"\p{Devanagari}"), ("arab", r"\p{Arabic}")))


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    for name, pat in _SCRIPTS:
        if pat.match(c):
            return name
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "other"


class Statistics:
    """known: (base kind, token) -> (count, count of the special case); totals: stops and those at block ends."""

    def __init__(self, known: dict[str, dict[str, tuple[int, int]]], stops: int = 0, stop_ends: int = 0):
        self.known = {k: known.get(k, {}) for k in _SPECIAL}
        self.rate = min(0.5, max(0.05, stop_ends / max(1.0, stops)))

    def ending(self, word: str) -> str:
        """How often the word, before a period, ends a block: never, seldom, as others, or unknown."""
        if _NUMBER.match(word):
            return "number"
        n, e = self.known["stop"].get(word, (0, 0))
        if e <= 0.02 * n * self.rate:
            return "never" if n * self.rate >= EXPECTED else "few"
        return "seldom" if e / n < 0.12 * self.rate else "often"

    def unit(self, word: str) -> bool:
        n, after = self.known["all"].get(word, (0, 0))
        return n >= 10 and after >= 0.8 * n

    def inside(self, word: str) -> str:
        n, c = self.known["cap"].get(word, (0, 0))
        return "rare" if n < 4 else "inside" if c > 0.03 * n else "first"

    def cluster(self, term: str, close: str, left: str) -> str:
        n, e = self.known["cluster"].get(f"{term[-1]}{close}|{left}", (0, 0))
        return "never" if e <= 0.02 * n * self.rate and n * self.rate >= EXPECTED else "ends"


#: Of each kind of count, the one of its special cases.
_SPECIAL = {"stop": "stop_end", "all": "after_number", "cap": "cap_inside", "cluster": "cluster_end"}


def following(tail: str, st: Statistics) -> str:
    """Class of what follows: its script or case, and whether a capital can stand inside sentences."""
    c = tail[0]
    if c in _OPENERS:
        return "open"
    if c in "([":
        return "bracket"
    if c.isdigit():
        return "digit"
    s = script(c)
    if s not in ("latin", "letter"):
        return s
    if not c.isupper():
        return "lower"
    m = _WORDS.match(tail)
    w = m.group() if m else c
    if _ROMAN.match(w) and len(w) < 5 and w not in ("I", "C", "L") or w == "I" and tail[1:2] in ".,)":
        return "roman"
    if tail[len(w) : len(w) + 1] == "." and len(w) <= 6 and tail[len(w) + 1 :].strip():
        return "dotted"
    return "cap_" + st.inside(w)


@lru_cache(maxsize=100_000)
def numeric(word: str) -> bool:
    return bool(_NUMBER.match(word))


_UPPER = ("cap_first", "cap_inside", "cap_rare")
_CASELESS = ("han", "hira", "kata", "thai", "deva", "arab")


def _side(c: str) -> str:
    s = script(c) if c else "none"
    return s if s in ("thai", "digit") else "open" if c in _OPENERS else "foreign"


def shape(word: str) -> str:
    if not word:
        return "none"
    if _NUMBER.match(word):
        return "number"
    if "." in word:
        return "inner"
    if len(word) == 1:
        return "upper1" if word.isupper() else "lower1"
    return ("Cap" if word[0].isupper() else "low") + ("2-3" if len(word) <= 3 else "4-5" if len(word) <= 5 else "6+")


def describe(c: Candidate, st: Statistics) -> tuple[list[str], int | None]:
    """Features, and the label where the corpus gives one."""
    nxt = following(c.tail, st)
    if not c.term:
        left, right = _side(c.word[-1:]), "foreign_sentence" if c.foreign else _side(c.tail[:1])
        f = [f"thai:{left}:{right}", f"thai_left:{left}:{c.word[-2:]}", f"thai_right:{right}:{c.tail[:2]}", f"thai_long:{right}:{min(3, len(c.tail) // 8)}"]
        return f, 0 if not c.foreign and (left, right) != ("thai", "thai") else None
    end, unit, sh = st.ending(c.word), st.unit(c.word), shape(c.word)
    if len(c.word) > 1 and c.word.isupper():  # all in capitals: the small form is better known
        small = st.ending(c.word.lower())
        end = end if small == "few" else small
    kind = "full" if c.term[-1] in _STOPS else "ask" if c.term[-1] in _FULL else "dots" if c.term in ("...", "…") or len(c.term) > 2 else c.term[-1]
    left = script(c.word[-1:])
    cluster = st.cluster(c.term, c.close, left)
    mark = "close" if c.close else "bare"
    number = bool(_NUMBER.match(c.before))
    if unit and number:  # whether the unit else ends blocks says nothing
        end = "unit"
    f = [f"k:{kind}:{mark}:{nxt}", f"k:{kind}:{mark}:{'hira' if nxt == 'hira' else 'other'}", f"n:{kind}:{nxt}", f"gap:{c.gap}:{kind}"]
    if kind == ".":
        go = "on" if nxt == "lower" else "new"
        f += [f"w:{left}:{c.word}", f"e:{end}:{nxt}", f"e:{end}:{go}", f"s:{sh}:{nxt}", f"s:{sh}", f"u:{unit}:{go}", f"un:{unit and number}:{go}", f"v:{_first(c.tail)}", f"ue:{unit}:{end}:{nxt}"]
    else:
        f += [f"c:{kind}:{mark}:{cluster}:{nxt}", f"c:{kind}:{mark}:{cluster}:{'hira' if nxt == 'hira' else nxt in _CASELESS}"]
    label: int | None = None
    if nxt == "lower" or kind != "." and c.close and nxt == "hira":
        label = 0
    elif kind == "." and end == "never" and not c.close and nxt in ("cap_inside", "cap_rare", "digit", "roman", "dotted", "bracket"):
        label = 0
    elif kind not in (".", "full") and c.close and cluster == "never" and nxt in _CASELESS:
        label = 0
    return f, label


def _first(tail: str) -> str:
    m = _WORDS.match(tail)
    return m.group().lower()[:20] if m else tail[:1]


def feature_ids(features: list[str]) -> list[int]:
    return [crc32(x.encode()) % WEIGHTS for x in features]


def _prior(features: list[str]) -> float:
    """Log odds before any training, for corpora too small to teach."""
    x = features[0]
    if x.startswith("thai"):
        return {"thai:thai:thai": 1.0, "thai:thai:foreign_sentence": 1.0}.get(x, -2.0)
    _, kind, mark, nxt = x.split(":")
    odds = {"lower": -4.0, "hira": -2.0 if mark == "close" else 2.0, "digit": -0.5, "roman": -1.0, "dotted": -0.5, "bracket": -0.5}.get(nxt, 1.5)
    if kind in ("full", "ask"):
        odds = 4.0 if mark == "bare" else odds
    if "un:True:new" in features:  # a unit after a figure is a word like others
        odds += 3.0
    if any(f in ("s:upper1", "s:lower1") for f in features) and "u:True:new" not in features:
        odds -= 3.0
    return odds


def train(rows: list[tuple[list[int], float, int, float]], rounds: int = 150, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by accelerated gradient steps. rows: feature slots, prior log odds, label, weight."""
    w = np.zeros(WEIGHTS)
    if not rows:
        return w
    rows = sorted(rows)
    where = np.concatenate([np.asarray(r[0]) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    base, y, n = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    seen = np.maximum(np.bincount(where, n[of], minlength=WEIGHTS), 1)
    step, v = 1.0 / (0.25 * 16), w.copy()
    for t in range(rounds):
        z = base + np.bincount(of, v[where], minlength=len(rows))
        g = np.bincount(where, (n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y))[of], minlength=WEIGHTS) / seen**0.85 + ridge * v / seen**0.5
        new = v - step * 4 * g
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


class Splitter:
    def __init__(self, st: Statistics, weights: np.ndarray):
        self.st, self.w = st, weights.astype(np.float32)
        self.memo: dict[tuple, bool] = {}

    def is_boundary(self, c: Candidate) -> bool:
        token = c.tail.split(None, 1)
        word = c.word if c.term == "." or not c.term else c.word[-1:]
        key = (word, numeric(c.before), c.term, c.close, c.gap, token[0], len(token) > 1, c.foreign)  # all that the features see
        got = self.memo.get(key)
        if got is None:
            f, _ = describe(c, self.st)
            got = _prior(f) + float(self.w[feature_ids(f)].sum()) > 0
            if len(self.memo) < 200_000:
                self.memo[key] = got
        return got

    def units(self, text: str) -> Iterator[tuple[int, int]]:
        for b in blocks(text):
            cuts = sorted({c.end for c in candidates(text, b) if self.is_boundary(c)}) if b.kind == "prose" else []
            at = b.start
            for cut in [*cuts, b.end]:
                part = text[at:cut]
                inner = part.strip()
                if inner:
                    s = at + len(part) - len(part.lstrip())
                    yield s, s + len(inner)
                at = cut


def labelled(text: str, st: Statistics) -> Iterator[tuple[list[int], float, int]]:
    """Labelled candidates of a text, its block ends (joined to the next block) among them."""
    found = [b for b in blocks(text) if b.kind == "prose"]
    for i, b in enumerate(found):
        for c in candidates(text, b):
            f, y = describe(c, st)
            if y is not None:
                yield feature_ids(f), _prior(f), y
        if i + 1 < len(found):
            body = text[b.start : b.end].rstrip()
            m = regex.search(rf"([{_TERMS}]+)([{_CLOSERS}]*)$", body)
            if m:
                word, before = _left(body, 0, m.start())
                tail = _tail(text, _SPACE.match(text, found[i + 1].start).end(), found[i + 1].end)
                f, _ = describe(Candidate(0, word, before, m[1], m[2], True, tail), st)
                yield feature_ids(f), _prior(f), 1
            elif _HAS_THAI.match(body[-1]):
                tail = _tail(text, _SPACE.match(text, found[i + 1].start).end(), found[i + 1].end)
                f, _ = describe(Candidate(0, body[-4:], "", "", "", True, tail), st)
                yield feature_ids(f), _prior(f), 1


def statistics(documents: DataFrame) -> Statistics:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Counts()
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    c.add(t)
            if len(c) > 500_000:
                yield pd.DataFrame(c.rows(), columns=["kind", "token", "n"])
                c = Counts()
        yield pd.DataFrame(c.rows(), columns=["kind", "token", "n"])

    counts = documents.select("text").mapInPandas(run, "kind string, token string, n bigint")
    special = F.create_map(*(F.lit(x) for base, kind in _SPECIAL.items() for x in (kind, base)))[F.col("kind")]
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    both = counts.withColumn("special", special).groupBy(F.coalesce("special", "kind").alias("base"), "token").agg(n(F.col("special").isNull()).alias("n"), n(F.col("special").isNotNull()).alias("s"))
    both = materialise(both, "sentence-tokens")
    total = {r.base: (r.n, r.s) for r in both.groupBy("base").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    stops, ends = total.get("stop", (0, 0))
    rate = Statistics({}, stops, ends).rate
    least = {"stop": EXPECTED / rate / 4, "all": 10, "cap": 4, "cluster": 1}  # rarer ones are as good as unknown
    enough = F.lit(False)
    for base, (all_, _) in total.items():
        enough |= (F.col("base") == base) & (F.col("n") >= max(least[base], SHARE * all_))
    known: dict[str, dict[str, tuple[int, int]]] = {}
    for r in both.filter(enough | ((F.col("base") == "stop") & (F.col("s") > 0) & (F.col("n") >= SHARE * stops))).collect():  # at most 1 / SHARE tokens a kind
        known.setdefault(r.base, {})[r.token] = (r.n, r.s)
    return Statistics(known, stops, ends)


def fit(documents: DataFrame, st: Statistics, sample: int = SAMPLE) -> np.ndarray:
    h = F.xxhash64("doc_id")
    top = documents.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if top is None:
        return train([])
    shared = documents.sparkSession.sparkContext.broadcast(st)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            rows = [r for t in pdf["text"] if t for r in labelled(t, s)]
            got = Counter((tuple(f), p, y) for f, p, y in rows)
            yield pd.DataFrame([(list(f), p, y, n) for (f, p, y), n in got.items()], columns=["f", "p", "y", "n"])

    few = documents.filter(h <= top).select("text").mapInPandas(run, "f array<int>, p double, y int, n int")
    pdf = few.groupBy("f", "p", "y").agg(F.sum("n").alias("n")).toPandas()  # candidates of at most `sample` documents
    return train([(list(f), p, y, float(min(n, REPEATS))) for f, p, y, n in zip(pdf["f"], pdf["p"], pdf["y"], pdf["n"])])


def sentences(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, start_char, end_char), one row per unit."""
    st = statistics(documents)
    splitter = documents.sparkSession.sparkContext.broadcast((st, fit(documents, st, sample)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = Splitter(*splitter.value)
        for pdf in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                for s, e in sp.units(t) if t else ():
                    ids.append(d)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"doc_id": ids, "start_char": starts, "end_char": ends})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, start_char int, end_char int")
