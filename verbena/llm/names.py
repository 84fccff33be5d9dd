"""Map free-entered names to a canonical list by a prefix-filtered set-similarity join.

A name is reduced to its two words (or initial and word); its tokens are the words' letter pairs,
marked by word. Tokens are ordered by global rarity. Two sets that are similar enough share a token of their
rare prefixes, and a second one of prefixes longer by one. The join's keys are the prefix tokens that few listed
names have, and pairs of tokens where the first is common, so that a common letter pair alone brings no two
names together however long the list. The length and the positional filter and a bitmap bound apply, Jaccard is verified exactly, and the entry most alike is kept; an edit
distance is checked after that and breaks ties. Typed names are reduced to distinct forms first, so a
name that makes up a third of all rows is joined once.

Defined results: null and blank names, and names that equal a listed name character for character,
give no row; a genus, family or placeholder alone, or a name too far from every entry, gives ref_id 0;
ties go to the fewer edits, then the lower ref_id; a hyphen inside a word does not part it, unless nothing else
parts the name; letters of any script count; repeated rows give one row; with an empty list
every name gives 0; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.windows import numbered
from ..runtime import BROADCAST_ROWS, at_most, checked_join, materialise, spread

#: Least Jaccard similarity of two token sets.
SIMILAR = 0.5
#: Most edits (exchange of neighbours counts one) between a typed name and its entry; of an abbreviated one.
EDITS, EDITS_SHORT = 3, 2
#: Listed names that have a token beyond which it counts as common.
COMMON = 256
#: Most edits where a second word has no more letters than this.
BRIEF, EDITS_BRIEF = 3, 1
#: Second words that name no species.
PLACEHOLDERS = ("sp", "spp", "indet", "ind", "nd", "cf", "aff", "especie", "species")
_DOUBT = ("cf", "aff", "conf", "affinis", "x")


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and their bases, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASES = _plain_letters()


def words(name: Column) -> Column:
    """Lower-case words of a typed name without accents, misread digits, family, doubt marks; an inverted name is turned."""
    s = F.lower(F.translate(F.regexp_replace(name, "[̀-ͯ]", ""), _ACCENTED, _BASES))
    for digit, letter in (("0", "o"), ("1", "l"), ("5", "s"), ("@", "a")):
        s = F.regexp_replace(s, f"(?<=[a-z@015]){digit}|{digit}(?=[a-z])", letter)
    s = F.regexp_replace(s, r"[\[(]\s*[a-z]+aceae\s*[\])]|\b[a-z]+aceae\b", " ")
    s = F.regexp_replace(s, r"[?*: \s]+", " ")
    s = F.regexp_replace(s, r"^\W*([a-z]{2,})\s*,\s*([a-z]+)\W*$", "$2 $1")
    s = F.regexp_replace(s, r"^\W*([a-z]{2,})\s*\(\s*([a-z]+)\s*\)\W*$", "$2 $1")
    parted = lambda t: F.filter(F.filter(F.split(t, r"[^\p{L}\p{M}]+"), lambda x: F.length(x) > 0), lambda x, i: (i == 0) | ~x.isin(*_DOUBT))
    whole = parted(F.regexp_replace(s, r"(?<=\p{L})[-‐‑](?=\p{L})", ""))
    return F.when(F.size(whole) > 1, whole).otherwise(parted(s))


def form(name: Column) -> Column:
    """"genus epithet", or "g epithet" of an abbreviated name; null where the name cannot mean a species."""
    w = words(name)
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    return F.when((F.length(b) > 1) & ~b.isin(*PLACEHOLDERS), F.concat_ws(" ", a, b))


def tokens(f: Column) -> Column:
    """Letter pairs of the padded words, marked by word."""
    def pairs(word: Column, mark: str) -> Column:
        p = F.concat(F.lit("^"), word, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.concat(F.lit(mark), p.substr(i, F.lit(2))))

    return F.array_distinct(F.concat(pairs(F.split_part(f, F.lit(" "), F.lit(1)), "g"), pairs(F.split_part(f, F.lit(" "), F.lit(2)), "e")))


def _ordered(sets: DataFrame, rarity: DataFrame, key: list[str]) -> DataFrame:
    """key, ts: each set's token ranks, rarest first."""
    flat = sets.select(*key, F.explode("tokens").alias("token"))
    return checked_join(flat, rarity, ["token"]).groupBy(*key).agg(F.sort_array(F.collect_list("rank")).alias("ts"))


_BIT_WORDS = 4


def _word(ranks: Column, k: int) -> Column:
    """The k-th word of 64 bits of a set's bitmap."""
    mine = F.filter(ranks, lambda x: F.pmod(F.shiftright(x, 7), F.lit(_BIT_WORDS)) == k)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(x, 1), F.lit(64)).cast("int"))))


def _ranked(tokens: DataFrame) -> DataFrame:
    """Adds rank: rarest first. tokens: (token, n), one row per token."""
    if at_most(tokens, BROADCAST_ROWS):
        return tokens.select("*", F.row_number().over(Window.orderBy("n", "token")).cast("bigint").alias("rank"))  # of few tokens, not of rows
    return numbered(tokens, ["n", "token"], "rank").withColumn("rank", F.col("rank").cast("bigint"))


def _keys() -> Column:
    """(key, got, place) of the prefixes one (of the first shared token) and two (of the second): single tokens, or pairs whose first token is common."""
    at = lambda p: F.transform(p, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    key = lambda k, got, i: F.struct(k.alias("key"), F.lit(got).alias("got"), i.alias("place"))
    rare = F.transform(F.filter(at("one"), lambda s: s["t"] % 2 == 0), lambda s: key(s["t"], 1, s["i"]))
    pairs = F.transform(F.filter(at("one"), lambda s: s["t"] % 2 == 1), lambda s: F.transform(F.filter(at("two"), lambda z: z["i"] > s["i"]), lambda z: key(F.shiftleft(s["t"], 32) + z["t"], 2, z["i"])))
    return F.concat(rare, F.flatten(pairs))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(l, r, jaccard) of all pairs at least ``threshold`` alike. left: (l, kind, tokens), right: (r, kind, tokens); only equal kinds meet.

    Prefix filter: a set of n tokens shares at least ceil(t n) of them with any set of Jaccard >= t, hence two of its first
    n - ceil(t n) + 2. Sets so small that one shared token is enough (n t <= 1) and that share a common one are joined on it.
    """
    left = materialise(left.filter(F.size("tokens") > 0), "names-left")
    right = materialise(right.filter(F.size("tokens") > 0), "names-right")
    both = left.select(F.explode("tokens").alias("token"), F.lit(0).alias("listed")).unionByName(right.select(F.explode("tokens").alias("token"), F.lit(1).alias("listed")))
    counts = both.groupBy("token").agg(F.count("*").alias("n"), F.sum("listed").alias("listed"))
    ranked = _ranked(materialise(counts, "names-tokens"))
    rarity = materialise(ranked.select("token", (F.col("rank") * 2 + (F.col("listed") > COMMON).cast("int")).alias("rank")), "names-rarity")  # the last bit: common
    n, m = F.size("lt"), F.size("rt")
    prefix = lambda k: F.slice("ts", 1, (F.size("ts") - F.ceil(F.size("ts") * threshold - 1e-9) + k).cast("int"))
    bits = lambda side: [_word(F.col("ts"), k).alias(f"{side}{k}") for k in range(_BIT_WORDS)]
    a = _ordered(left, rarity, ["l", "kind"]).select("l", "kind", F.col("ts").alias("lt"), prefix(1).alias("one"), prefix(2).alias("two"), *bits("lb"))
    a = materialise(spread(a, "l"), "names-own")  # or its bitmaps would be made again for every pair
    b = materialise(_ordered(right, rarity, ["r", "kind"]).select("r", "kind", F.col("ts").alias("rt"), prefix(1).alias("one"), prefix(2).alias("two"), *bits("rb")), "names-sets")
    need = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    alike = (m >= n * threshold - 1e-9) & (n >= m * threshold - 1e-9)
    # Sets share at most as many tokens as their bitmaps share bits, and as many more as fell together in the left one.
    common = sum((F.bit_count(F.col(f"lb{k}").bitwiseAND(F.col(f"rb{k}"))) for k in range(_BIT_WORDS)), F.lit(0))
    own = sum((F.bit_count(f"lb{k}") for k in range(_BIT_WORDS)), F.lit(0))

    x = a.select("*", F.explode(_keys()).alias("k")).select("l", "kind", "lt", F.col("two").alias("lp"), *(f"lb{k}" for k in range(_BIT_WORDS)), "k.key", "k.got", F.col("k.place").alias("i"))
    y = b.select("*", F.explode(_keys()).alias("k")).select("r", "kind", "rt", F.col("two").alias("rp"), *(f"rb{k}" for k in range(_BIT_WORDS)), "k.key", F.col("k.place").alias("j"))
    y = materialise(y, "names-prefixes")
    most = F.col("got") + F.least(n - F.col("i") - 1, m - F.col("j") - 1)
    first = F.array_intersect("lp", "rp")  # in the order of lp: each pair counts once, at its first shared token or two
    here = F.when(F.col("got") == 1, first[0]).otherwise(F.shiftleft(first[0], 32) + first[1]) == F.col("key")
    shared = F.size(F.array_intersect("lt", "rt"))
    jaccard = shared / (n + m - shared)
    # A case keeps the order: the cheap bounds are tested before any set is intersected.
    fits = F.when(alike & (most >= need), F.when(common + n - own >= need, F.when(here, jaccard >= threshold - 1e-9)))
    met = checked_join(x, y, ["kind", "key"], salt_on=["l"]).filter(F.coalesce(fits, F.lit(False))).select("l", "r", "kind", "lt", "rt")

    tiny = a.filter(F.size("lt") * threshold <= 1 + 1e-9).select("l", "kind", "lt", F.explode(F.filter("lt", lambda t: t % 2 == 1)).alias("key"))
    small = b.filter(F.size("rt") * threshold * threshold <= 1 + 1e-9).select("r", "kind", "rt", F.explode("rt").alias("key"))
    single = checked_join(tiny, materialise(small, "names-small"), ["kind", "key"], salt_on=["l"]).filter((shared == 1) & (jaccard >= threshold - 1e-9)).select("l", "r", "kind", "lt", "rt")
    pairs = met.unionByName(single).select("l", "r", "kind", jaccard.alias("jaccard"))
    return materialise(pairs, "names-similar")  # so that later filters do not come before the bounds


def _edits(a: str, b: str) -> int:
    """Edit distance in which the exchange of neighbours counts one."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


@F.pandas_udf(T.IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_edits(x, y) for x, y in zip(a, b)])


def resolve(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """typed (name) and listed (ref_id, entry): (name, ref_id, entry, jaccard, edits); ref_id 0 where none is meant."""
    names = typed.select("name").distinct().withColumn("form", form(F.col("name")))
    names = materialise(names, "names-typed")
    short = F.length(F.split_part("form", F.lit(" "), F.lit(1))) == 1
    left = spread(names.filter("form is not null").select(F.col("form").alias("l")), "l").distinct()
    left = left.withColumn("kind", F.length(F.split_part("l", F.lit(" "), F.lit(1))) == 1).withColumn("tokens", tokens(F.col("l")))
    entries = materialise(listed.select("ref_id", "entry", form(F.col("entry")).alias("r")).filter("r is not null"), "names-listed")
    full = entries.select("r", F.lit(False).alias("kind")).distinct()
    brief = F.concat_ws(" ", F.substring("r", 1, 1), F.split_part("r", F.lit(" "), F.lit(2)))
    right = full.unionByName(entries.select(brief.alias("r"), F.lit(True).alias("kind")).distinct())
    pairs = similar_pairs(left, right.withColumn("tokens", tokens(F.col("r")))).withColumn("lev", F.levenshtein("l", "r"))
    pairs = pairs.filter((F.col("lev") <= 2 * EDITS) & (~F.col("kind") | (F.substring("l", 1, 1) == F.substring("r", 1, 1))))
    pairs = materialise(pairs, "names-pairs")
    second = lambda c: F.length(F.split_part(c, F.lit(" "), F.lit(2)))
    limit = F.when(F.least(second("l"), second("r")) <= BRIEF, EDITS_BRIEF).when(F.col("kind"), EDITS_SHORT).otherwise(EDITS)
    near = pairs.filter(F.col("lev") <= limit).withColumn("edits", F.col("lev"))
    swapped = pairs.filter((F.col("lev") > limit) & (F.col("lev") <= 2 * limit)).withColumn("edits", edits("l", "r")).filter(F.col("edits") <= limit)  # only exchanges can make it fewer
    kept = near.unionByName(swapped)
    ids = entries.select("r", "ref_id", "entry", F.lit(False).alias("kind")).unionByName(entries.select(brief.alias("r"), "ref_id", "entry", F.lit(True).alias("kind")))
    ranked = checked_join(kept, materialise(ids, "names-ids"), ["r", "kind"], salt_on=["l"])
    best = ranked.groupBy("l").agg(F.min_by(F.struct("ref_id", "entry", "jaccard", "edits"), F.struct(-F.col("jaccard"), "edits", "ref_id")).alias("b"))
    out = names.join(best, names["form"] == best["l"], "left")
    return out.select("name", F.coalesce("b.ref_id", F.lit(0).cast("bigint")).alias("ref_id"), "b.entry", "b.jaccard", "b.edits", short.alias("abbreviated"))


def map_names(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows (src_table, row_id, name); reference (ref_id, species, synonyms): (src_table, row_id, name, ref_id) of the names that are not already a listed species."""
    exact = reference.select(F.col("species").alias("name")).filter("name is not null").distinct()
    rows = rows.filter(F.length(F.trim(F.regexp_replace("name", r"[\s ]+", " "))) > 0)
    rows = materialise(checked_join(rows, exact, ["name"], "left_anti", salt_on=["row_id"]), "names-rows")
    listed = reference.select("ref_id", F.explode(F.concat(F.array("species"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("entry")).filter("entry is not null")
    found = materialise(resolve(rows, listed), "names-found")
    return checked_join(rows, found.select("name", "ref_id", "entry", "edits"), ["name"], "left", salt_on=["row_id"])
