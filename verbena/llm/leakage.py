"""Find evaluation texts inside a training corpus.

The n-grams of the normalised test texts become 64-bit hashes in one sorted array, which is broadcast; its size
is known before it is built (some 16 bytes a gram), and a test set beyond the bound is worked off in blocks. A scan
of the corpus folds and tokenises many documents at once, hashes all their windows in vector operations, and probes
the array. The grams that hit are verified token by token, chained in both orders, and the share of the item that
the passage holds is measured. No document is shuffled, and the scan leaves no window out.

Tokens are words without case, accents and punctuation, or single characters in scripts without spaces.

Defined results: null or empty documents and items give no row; a document may hold several items, an
item may stand in many documents; repeated documents each give their rows; an item shorter than one gram
is found where all its tokens stand side by side; an empty item table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_join, materialise

#: Share of an item that makes a leak, and the share of its grams that must hit before it is verified.
SHARE, HITS = 0.6, 0.22
#: Weight of a gram: words weigh 2, characters 1.
GRAM = 6
#: Longest foreign stretch within a passage, in weight, and the sentence ends in a longer one: those of the sentence before it and its own.
GAP, STOPS = 110, 2
#: Longest stretch of replaced or misspelt words between two hits that still counts as covered, in tokens.
SLIP = 9
#: Characters of test text per broadcast index, and of documents that are tokenised at once.
BLOCK_CHARS, CHUNK_CHARS = 40_000_000, 2_000_000

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_TOKEN = regex.compile(rf"\x00|[{_UNSPACED}]\p{{M}}*|[[\p{{L}}\p{{N}}\p{{M}}]--[{_UNSPACED}]]+", regex.V1)
_MARKS = regex.compile("[\u0300-\u036f\u064b-\u065f]+")
_SINGLE = regex.compile(rf"[{_UNSPACED}]")
_STOP = regex.compile(r"(?<=[\p{L}\p{M}]{4}|\p{N}|[\p{Han}\p{Hiragana}\p{Katakana}])[.!?…][^\p{L}\p{N}]*\s(?!\s*\p{Ll})|[。！？।॥؟۔｡]|(?<=\p{Thai})\s+(?=\p{Thai})|\n\s*\n")


#: Characters outside Latin letters and common marks; a text without them has the same tokens by the plainer pattern, which is three times as fast.
_RARE = re.compile("[^\x01-\u0233\u2010-\u2027\u2030-\u203a]")
_PLAIN_TOKEN = re.compile(r"\x00|[^\W_]+")


@lru_cache(maxsize=100_000)
def _width(c: str) -> int:
    """Characters that one character is folded into."""
    return len(_fold(c))


def _tokens(texts: list[str]) -> tuple[list[str], list[int]]:
    """The tokens of all texts, folded, with \x00 between two texts, and the numbers of the texts in that order."""
    order: tuple[list[int], list[int]] = ([], [])
    folded: tuple[list[str], list[str]] = ([], [])
    for i, t in enumerate(texts):
        t = _fold(t.replace("\x00", " "))
        rare = _RARE.search(t) is not None
        order[rare].append(i)
        folded[rare].append(t)
    parts = [pattern.findall("\x00".join(some)) for pattern, some in zip((_PLAIN_TOKEN, _TOKEN), folded) if some]
    return [*parts[0], "\x00", *parts[1]] if len(parts) == 2 else parts[0], order[0] + order[1]


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def tokenise(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Folded tokens, their weights, and their places in the text."""
    text = text.replace("\x00", " ")
    folded = _fold(text)
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(folded)]
    weights = [1 if _SINGLE.match(t) else 2 for t, _, _ in found]
    if text.isascii():
        return [t for t, _, _ in found], weights, [(s, e) for _, s, e in found]
    origin = np.repeat(np.arange(len(text)), [1 if c < "\x80" else _width(c) for c in text])  # folding a text gives as many characters as folding each of its own
    return [t for t, _, _ in found], weights, [(int(origin[s]), int(origin[e - 1]) + 1) for _, s, e in found]


#: Id of what stands between two texts.
_BETWEEN = -2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of ids."""
    h = lengths.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(lengths.max(initial=0))):
            more = lengths > i
            step = (h ^ (h >> np.uint64(29))) * _BASE + ids[np.minimum(starts + i, len(ids) - 1)].astype(np.uint64)
            h = np.where(more, step, h)
    return h


def windows(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the shortest run that weighs GRAM at each place; runs with an unknown token (id below 0) are none."""
    known = ids >= 0
    cum = np.concatenate([[0], np.cumsum(weights)])
    starts = np.flatnonzero(known)
    ends = np.searchsorted(cum, cum[starts] + GRAM)
    ok = ends <= len(ids)
    starts, ends = starts[ok], ends[ok]
    gaps = np.concatenate([[0], np.cumsum(~known)])
    ok = gaps[ends] == gaps[starts]
    starts, ends = starts[ok], ends[ok]
    return starts, ends - starts, _runs(ids, starts, ends - starts)


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.weights = [], [], []
        self.vocabulary: dict[str, int] = {}
        parts, small = [], []
        for n, (item, text) in enumerate(items):
            tokens, weights, _ = tokenise(text)
            self.ids.append(item)
            self.words.append(tokens)
            codes = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens], np.int64)
            starts, _, h = windows(codes, np.array(weights, np.int64))
            parts.append((h, np.full(len(h), n, np.int32), starts.astype(np.int32)))
            if tokens and not len(h):
                one = np.array([len(tokens)])
                small.append((_runs(codes, np.array([0]), one)[0], n, len(tokens)))
        self.n_grams = np.array([len(h) for h, _, _ in parts], np.int64)
        self.heavy = np.array([1 if _SINGLE.match(t) else 2 for t in self.vocabulary] + [2], np.int64)  # the last for unknown tokens
        self.vocabulary["\x00"] = _BETWEEN
        keys, item, place = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(3))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.small = {k: np.sort(np.array([h for h, _, m in small if m == k], np.uint64)) for k in {m for _, _, m in small}}  # by length
        self.small_items: dict[int, list[int]] = defaultdict(list)
        for h, n, _ in small:
            self.small_items[int(h)].append(n)

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, int]]:
        """(number of the text, item, share, first character, end) of each item each text holds."""
        tokens, order = _tokens(texts)
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
        between = np.flatnonzero(ids == _BETWEEN)
        texts = [texts[i] for i in order]
        first = np.concatenate([[0], between + 1])  # the first token of each text
        starts, _, h = windows(ids, self.heavy[np.maximum(ids, -1)])
        lo, hi = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
        met = np.flatnonzero(hi > lo)
        n = hi[met] - lo[met]
        at = np.repeat(lo[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(starts[met], n)
        doc, item, place = np.searchsorted(between, start), self.item[at].astype(np.int64), self.place[at].astype(np.int64)
        if len(at):
            width = int(place.max()) + 1
            pairs, count = np.unique(np.unique((doc * len(self.ids) + item) * width + place) // width, return_counts=True)
            enough = pairs[count >= HITS * self.n_grams[pairs % len(self.ids)]]
            wanted: dict[int, list[int]] = defaultdict(list)
            for pair in enough.tolist():
                wanted[pair // len(self.ids)].append(pair % len(self.ids))
            for d, some in wanted.items():
                mine = slice(*np.searchsorted(doc, [d, d + 1]))  # starts ascend, and so do the texts
                yield from ((order[d], *hit) for hit in self._verify(texts[d], some, start[mine] - first[d], item[mine], place[mine]))
        for k, keys in self.small.items():
            yield from ((order[d], *hit) for d, *hit in self._whole(texts, ids, between, first, k, keys))

    def _whole(self, texts: list[str], ids: np.ndarray, between: np.ndarray, first: np.ndarray, k: int, keys: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Items of k tokens that are shorter than a gram."""
        gaps = np.concatenate([[0], np.cumsum(ids < 0)])
        starts = np.flatnonzero(gaps[k:] == gaps[: len(gaps) - k]) if len(ids) >= k else np.zeros(0, np.int64)
        h = _runs(ids, starts, np.full(len(starts), k)) if len(starts) else np.zeros(0, np.uint64)
        place = np.searchsorted(keys, h)
        hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == h)
        done = set()
        for s, x in zip(starts[hit].tolist(), h[hit].tolist()):
            d = int(np.searchsorted(between, s))
            for n in self.small_items[x]:
                if (d, n) not in done:
                    done.add((d, n))
                    tokens, _, spans = tokenise(texts[d])
                    j = s - int(first[d])
                    if tokens[j : j + k] == self.words[n]:
                        yield d, self.ids[n], 1.0, spans[j][0], spans[j + k - 1][1]

    def _verify(self, text: str, wanted: list[int], at: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        tokens, weights, spans = tokenise(text)
        ends = [0]
        for w in weights:
            ends.append(ends[-1] + w)
        begins = [s for s, _ in spans]
        stops = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(stops, np.searchsorted(begins, [m.start() for m in _STOP.finditer(text)]), 1)  # before the token that follows
        stops = np.cumsum(stops)
        for n in wanted:
            words = self.words[n]
            pairs = sorted((int(j), int(k)) for j, k in zip(at[item == n], place[item == n]) if tokens[j : j + 3] == words[k : k + 3])
            best = _chain(pairs, words, tokens, ends, weights, stops) if len({k for _, k in pairs}) >= HITS * self.n_grams[n] else None
            if best and best[0] >= SHARE - 1e-9:
                yield self.ids[n], best[0], spans[best[1]][0], spans[min(best[2], len(spans)) - 1][1]

    def find(self, text: str) -> Iterator[tuple[int, float, int, int]]:
        return ((i, *rest) for _, i, *rest in self.scan([text]))


def _alike(a: str, b: str) -> bool:
    """Equal, or a slip: almost the same letters in almost the same number."""
    if a == b:
        return True
    x, y = Counter(a), Counter(b)
    return len(a) > 2 and abs(len(a) - len(b)) <= 1 and sum((x - y).values()) + sum((y - x).values()) <= 2


def _slips(a: list[str], b: list[str]) -> bool:
    """Whether the words between two hits are the item's but for slips and single replaced words."""
    if len(a) == len(b):
        strange = sum(not _alike(x, y) for x, y in zip(a, b))
    else:
        left = list(b)
        strange = 0
        for x in a:
            k = next((i for i, y in enumerate(left) if _alike(x, y)), None)
            if k is None:
                strange += 1
            else:
                del left[: k + 1]
    return strange <= max(1, len(a) // 3)


def _reach(a: list[str], b: list[str]) -> int:
    """How many of the item's words a passage goes on for beyond its last hit, slips and single replaced words included."""
    got = missed = 0
    for i, (x, y) in enumerate(zip(a, b)):
        if _alike(x, y):
            got, missed = i + 1, 0
        else:
            missed += 1
            if missed > 1:
                break
    return got


def _chain(pairs: list[tuple[int, int]], words: list[str], tokens: list[str], ends: list[int], weights: list[int], stops: np.ndarray) -> tuple[float, int, int] | None:
    """Best chain of diagonal runs, as (covered share of the item, first and end token of the passage).

    Between two runs at most GAP of foreign text may stand, or any one sentence: of the runs further back only the best one
    per place in the item can matter, so those are kept in queues from which they leave as a further sentence ends.
    """
    lengths = [len(w) for w in words]
    runs: dict[tuple[int, int], list[int]] = {}
    open_runs: dict[int, tuple[int, int]] = {}
    for j, k in pairs:  # j ascends
        d = j - k
        start = open_runs.get(d)
        if start and runs[start][1] + 1 >= j:
            runs[start][1] = j
        else:
            open_runs[d] = (j, k)
            runs[(j, k)] = [j, j]
    span = 3 if min(weights, default=2) == 2 else None
    blocks = []
    for (j, k), (_, last) in runs.items():
        e = last
        w = 0
        while e < len(weights) and w < GRAM:
            w += weights[e]
            e += 1
        e = last + span if span else e
        blocks.append((j, e, k, k + e - j))  # doc [j, e), item [k, ..)
    blocks.sort()
    reach = GAP + 2 * (len(lengths) + GRAM)
    place = [0]
    for x in lengths:
        place.append(place[-1] + x)
    total = place[-1] or 1
    state: list[tuple[int, int]] = []  # covered characters, first block
    best = (0, 0, 0, 0)
    far: dict[int, deque[tuple[int, int, int]]] = defaultdict(deque)  # per end in the item: (covered, place in the document, first block), best first
    waiting = 0  # blocks from here on are still near
    for n, (j, e, k, f) in enumerate(blocks):
        f = min(f, len(lengths))
        top, first = place[f] - place[k], n
        while waiting < n and ends[j] - ends[blocks[waiting][0]] > reach:
            _, pe, pk, pf = blocks[waiting]
            queue, got = far[pf], state[waiting]
            while queue and queue[-1][0] <= got[0] and queue[-1][1] <= pe:
                queue.pop()
            queue.append((got[0], pe, got[1]))
            waiting += 1
        for p in range(n - 1, waiting - 1, -1):
            pj, pe, pk, pf = blocks[p]
            if pk >= k or pj >= j or pe > e or pf > f:
                continue
            a, b = max(k, pf), max(j, pe)
            if b > pe and ends[b] - ends[pe] > GAP and stops[b] - stops[pe] > STOPS:
                continue
            gain = place[f] - place[max(k, pf)]
            lost, extra = a - pf, b - pe
            if lost > SLIP:  # a passage leaves nothing of the item out
                continue
            if 0 < lost <= SLIP and extra <= lost + 3 and _slips(words[pf:a], tokens[pe:b]):
                gain += place[a] - place[pf]
            if state[p][0] + gain > top:
                top, first = state[p][0] + gain, state[p][1]
        for pf in range(max(0, k - SLIP), k + 1) if far else ():
            queue = far.get(pf)
            while queue and stops[j] - stops[queue[0][1]] > STOPS:
                queue.popleft()
            if queue and queue[0][0] + place[f] - place[k] > top:
                top, first = queue[0][0] + place[f] - place[k], queue[0][2]
        state.append((top, first))
        if top > best[0]:
            best = (top, first, n, f)
    if not blocks:
        return None
    top, first, last, f = best
    j, _, k, _ = blocks[first]
    before = _reach(words[:k][::-1], tokens[max(0, j - k - 8) : j][::-1])
    after = _reach(words[f:], tokens[blocks[last][1] : blocks[last][1] + len(words) - f + 8])
    top += place[k] - place[k - before] + place[f + after] - place[f]
    return top / total, max(0, j - before), min(len(tokens), blocks[last][1] + after)


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the non-empty texts, in groups of at most CHUNK_CHARS (a longer text alone)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if group and size + len(t) > CHUNK_CHARS:
                yield group
                group, size = [], 0
            group.append(i)
            size += len(t)
    if group:
        yield group


def _scan(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            rows = [(ids[group[d]], *hit) for group in _chunks(texts) for d, *hit in ix.scan([texts[i] for i in group])]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "start_char", "end_char"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint, share double, start_char int, end_char int")


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, share, start_char, end_char) of every document that holds at least SHARE of an item's text as one passage.

    documents: doc_id, text; items: item_id, text. A test set of more than ``block_chars`` characters takes a scan per block.
    """
    items = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    out = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _scan(documents, Index(sorted((r.item_id, r.text) for r in mine.collect())))  # at most a block of test text
        found = found if blocks == 1 else materialise(found, "leaks-block")
        out = found if out is None else out.unionByName(found)
    return out


def without_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the leaked passages cut out; ``found`` as from ``leaks``. Documents left empty are dropped."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_char", "end_char"))).alias("cut"))
    joined = checked_join(documents, materialise(spans, "leak-spans"), ["doc_id"], "left")  # few documents leak: the corpus is then not shuffled
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    kept = F.aggregate(
        "cut", start, lambda acc, s: F.struct(F.concat(acc.kept, F.when(s.start_char > acc.at, F.substring(F.col("text"), acc.at + 1, s.start_char - acc.at)).otherwise("")).alias("kept"), F.greatest(acc.at, s.end_char).alias("at"))
    )
    clean = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.concat(kept.kept, F.substring(F.col("text"), kept.at + 1, F.length("text"))))
    return joined.withColumn("text", clean).drop("cut").filter(F.length(F.trim("text")) > 0)
