"""Queries of the text operators over the scanned notes and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators.scoring import elevation_plausibility as scored
from ..runtime import table
from .evaluation import rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RULES = [(r"\s+", " "), (r"([a-z])[-¬] ([a-z])", "$1$2"), (r"\bFl\. ", "flor: "), (r"\(\s+", "(")]


@query(r"select pick_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(habitat_raw, '\s+', ' ', 'g'), '([a-z])[-¬] ([a-z])', '\1\2', 'g'), '\bFl\. ', 'flor: ', 'g'), '\(\s+', '(', 'g') text from picked_species_enhanced")
def ocr_repair(spark, sf_dir):
    return table(spark, sf_dir, "picked_species_enhanced").select("pick_id", X.ruled("habitat_raw", RULES).alias("text"))


def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.unaccented("text").alias("folded"))


QUERIES["accent_fold"] = accent_fold


# Heights, written out pattern by pattern for the SQL side: links of two heights, then one height.
_PAIRS = [
    r"(?i)(\d[\d\s]*(?:,\d+)?)\s*(?:-|–|a)\s*(\d[\d\s]*(?:,\d+)?)\s*m",
    r"(?i)entre\s+(\d{3,4})\s+y\s+(\d{3,4})\s*m",
    r"(?i)(?:de|desde)\s+(\d{3,4})\s+(?:a|hasta)\s+(\d{3,4})\s*m",
    r"(?i)(\d{3,4})\s*m\s+(?:a|hasta|y)\s+(\d{3,4})\s*m",
]
_INT = "try_cast(trim(replace(replace({x}, ' ', ''), ',', ''), e' \\t\\n\\r') as bigint)"


def _heights(c: str) -> str:
    """SQL: the list of heights of a text, ascending."""
    both = [f"flatten(list_transform(list_filter(list_zip(regexp_extract_all({c}, '{p}', 1), regexp_extract_all({c}, '{p}', 2)), lambda z: {_INT.format(x='z[1]')} is not null and {_INT.format(x='z[2]')} is not null), lambda z: [{_INT.format(x='z[1]')}, {_INT.format(x='z[2]')}]))" for p in _PAIRS]
    single = f"list_filter(list_transform(regexp_extract_all({c}, '(?i)(\\d{{{{3,4}}}})\\s*m', 1), lambda x: {_INT.format(x='x')}), lambda h: h between 0 and 4000)".replace("{{", "{").replace("}}", "}")
    return f"list_sort(list_distinct(list_concat({', '.join(both)}, {single})))"


@query(f"select doc_id, nullif(array_to_string({_heights('text')}, ','), '') heights from documents")
def elevation_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.concat_ws(",", F.transform(X.plain_elevations("text"), lambda x: x.cast("string"))), F.lit("")).alias("heights"))


_RANGE = r"(?:\(([—–\-]?\d+[—–\-]?)\)\s*)?(\d+)\s*[—–\-]+\s*(\d+)(?:\s*\(([—–\-]?\d+(?:[—–\-]\d+)?)\))?\s*m\b"  # fixed value: how a band is printed
_G = lambda k: f"nullif(regexp_extract(habitat_raw, '{_RANGE}', {k}), '')"
_TOKEN = lambda g, k: f"try_cast(list_filter(string_split_regex({g}, '[^0-9]+'), lambda x: x <> '')[{k}] as int)"
_OUT = lambda g: f"case when {_TOKEN(g, 2)} is not null or {_TOKEN(g, 1)} < lo then {_TOKEN(g, 1)} end {g}_min, case when {_TOKEN(g, 2)} is not null then {_TOKEN(g, 2)} when {_TOKEN(g, 1)} >= lo then {_TOKEN(g, 1)} end {g}_max"


@query(f"""with g as (select pick_id, {_G(1)} lead, try_cast({_G(2)} as int) lo, try_cast({_G(3)} as int) hi, {_G(4)} trail, try_cast(nullif(regexp_extract(habitat_raw, '\\b(\\d{{3,4}})\\s*m\\b', 1), '') as int) single from picked_species_enhanced),
h as (select *, {_OUT("lead")}, {_OUT("trail")} from g)
select pick_id, coalesce(lo, single) low, coalesce(hi, single) high, coalesce(trail_min, lead_min) outlier_min, coalesce(trail_max, lead_max) outlier_max from h""")
def elevation_range_parse(spark, sf_dir):
    return table(spark, sf_dir, "picked_species_enhanced").select("pick_id", X.elevation_range("habitat_raw").alias("r")).select("pick_id", "r.*")


_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_AFTER = f"case when regexp_matches(habitat_raw, '{_RANGE}') then regexp_extract(habitat_raw, '(?s)^.*?{_RANGE}(.*)$', 5) else regexp_extract(habitat_raw, '(?s)^.*?\\b\\d{{3,4}}\\s*m\\b(.*)$', 1) end"
_NOTES = _STRIP(f"regexp_replace({_STRIP(_AFTER)}, '^;+', '')")
_NOTES = f"string_split_regex({_NOTES}, '\\s*\\(')[1]"
_NOTES = _STRIP(f"regexp_replace({_STRIP(f'regexp_replace({_NOTES}, {chr(39)}(?s)\\b(?:Fl|Fr)\\.\\b.*{chr(39)}, {chr(39)}{chr(39)})')}, '[;,]+$', '')")


@query(f"select pick_id, {_STRIP("string_split_regex(habitat_raw, ',|\\d{3,4}\\s*[—–\\-]')[1]")} habitat, {_NOTES} notes from picked_species_enhanced")
def habitat_geo_notes(spark, sf_dir):
    return table(spark, sf_dir, "picked_species_enhanced").select("pick_id", X.habitat_type("habitat_raw").alias("habitat"), X.geographic_notes("habitat_raw").alias("notes"))


_OPEN = "|".join(X.HABITAT_OPENINGS)
_MAYBE = "|".join(X.HABITAT_DOUBTFUL)
_PLACE = "|".join(w.replace(".", "\\.") for w in X.HABITAT_PLACES)


@query(f"""with l as (select pick_id, unnest(string_split(habitat_raw, chr(10))) line, generate_subscripts(string_split(habitat_raw, chr(10)), 1) i from picked_species_enhanced where habitat_raw is not null),
s as (select pick_id, i, {_STRIP("line")} line from l),
g as (select *, starts, heights, regexp_matches(line, '^({_MAYBE})') doubtful, regexp_matches(line, '\\b(?:{_PLACE})\\b') place from (select *, regexp_matches(line, '^({_OPEN})') starts, regexp_matches(line, '{_RANGE}') or regexp_matches(line, '\\b\\d{{3,4}}\\s*m\\b') heights from s)),
r as (select *, case when length(line) < 10 then null when starts and (heights or place) then 1 when starts then 2 when heights and place then 3 when doubtful and heights and place then 4 end grade from g),
b as (select pick_id, arg_min(i, (grade, i)) top from r where grade is not null group by all),
f as (select r.pick_id, top, i, line, line = '' or regexp_matches(line, '^\\d{{2,4}}$') or contains(line, 'Manual de Plantas') or regexp_matches(line, '^[A-Z][a-z]+ [a-z]+\\s+[A-Z]') closing from r join b using (pick_id) where i between top and top + 5),
e as (select pick_id, min(i) filter (where closing and i > top) stop from f group by all)
select p.pick_id, t.line from picked_species_enhanced p left join (select pick_id, string_agg(line, ' ' order by i) line from f join e using (pick_id) where stop is null or i < stop group by all) t using (pick_id)""")
def habitat_lines(spark, sf_dir):
    """The habitat sentence of each note, by the priorities of its lines."""
    return table(spark, sf_dir, "picked_species_enhanced").select("pick_id", X.habitat_line("habitat_raw").alias("line"))


def species_blocks(spark, sf_dir):
    """The entry of each document's species in its text, and how it was found."""
    t = table(spark, sf_dir, "documents").filter("especie is not null")
    return t.select("doc_id", X.species_block("text", "especie", 300).alias("b")).select("doc_id", "b.block", "b.method")


QUERIES["species_blocks"] = species_blocks


@query("select doc_id, regexp_replace(case when instr(text, '¿') > 0 then substring(text, instr(text, '¿') + 1) else text end, '^\\s+|\\s+$', '', 'g') answer from documents")
def answer_marker_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.after_marker("text", "¿").alias("answer"))


@query("select doc_id, nullif(trim(regexp_extract(text, '(?m)^Le relevé[^:\\n]*:[ \\t]*(.*)$', 1), ' '), '') head from documents")
def header_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.header_value("text", "Le relevé").alias("head"))


def section_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.section("text", "Hábitat y altitud").alias("section"))


QUERIES["section_extract"] = section_extract

# Ordered repairs of a scanned catalogue (pattern, replacement; \\1 as $1).
CATALOGUE_RULES = [
    (r"(\w+)-\s*\n?\s*([a-záéíóúüñ])", "$1$2"),
    (r"(\w+)¬\s*([a-záéíóúüñ])", "$1$2"),
    (r"\bDivisi6n\b", "División"),
    (r"\bdivisi6n\b", "división"),
    (r"\bregi6n\b", "región"),
    (r"\bRegiOn\b", "Región"),
    (r"\bregiOn\b", "región"),
    (r"\bregidn\b", "región"),
    (r"\bO—", "0–"),
    (r"\bO-", "0–"),
    (r"\b0Q—", "0–"),
    (r"\(O—\)", "(0–)"),
    (r"\(O-\)", "(0–)"),
    (r"\bFI\.", "Fl."),
    (r"\bFI ", "Fl. "),
    (r"Costefi([ao])", "Costeñ$1"),
    (r"costefi([ao])", "costeñ$1"),
    (r"Montafi([ao])", "Montañ$1"),
    (r"montafi([ao])", "montañ$1"),
    (r"Tamafi([ao])", "Tamañ$1"),
    (r"\bIlanuras\b", "llanuras"),
    (r"\blanuras\b", "llanuras"),
    (r"\bht[i]*medo\b", "húmedo"),
    (r"\bht[i]*meda\b", "húmeda"),
    (r"\bhi+medo\b", "húmedo"),
    (r"\bhumedo\b", "húmedo"),
    (r"\bhumeda\b", "húmeda"),
    (r"\bhumedad\b", "humedad"),
    (r"(\d)—(\d)", "$1–$2"),
    (r"(\d)—\s+(\d)", "$1–$2"),
    (r"(\d)-—(\d)", "$1–$2"),
    (r"\bh[ti]+medos\b", "húmedos"),
    (r"\bTarrazt\b", "Tarrazú"),
    (r"\bDivisién\b", "División"),
    (r"\bdivisién\b", "división"),
    (r"\bTriarán\b", "Tilarán"),
    (r"[£±]", ""),
    (r"\bSO—\)", "0–)"),
    (r"\(SO—\)", "(0–)"),
    (r"(\d)\+\?", "$1"),
    (r"(\d)\+(?=[)\s])", "$1"),
    (r"(\d+)-(\d+)-(\d+)\)\s*m", "$1-$2(-$3) m"),
    (r"[ \t]+", " "),
    (r"^\s+|\s+$", ""),
]
CATALOGUE_TEXTS = ("geographic_notes", "habitat_raw", "habitat_type", "species", "family", "order_name", "class_name", "phylum")


def catalogue_repair(spark, sf_dir):
    """All text columns of the catalogue that the table has, repaired by the ordered rules."""
    t = table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "species", "habitat_raw", "habitat_type", "geographic_notes")
    return X.repaired(t, CATALOGUE_TEXTS, CATALOGUE_RULES)


QUERIES["catalogue_repair"] = catalogue_repair

PATTERNS = [(r"(?i)vert\. Pac\.", ["PAC"]), (r"(?i)vert\. Carib\.", ["CAR"]), (r"(?i)ambas verts\.", ["PAC", "CAR"]), (r"(?i)sector centro", ["CEN"]), (r"(?i)Llanos", ["LLA"])]
_CODES = " || ".join(f"case when regexp_matches(geographic_notes, '{p}') then {codes} else [] end" for p, codes in PATTERNS)


@query(f"select pick_id, array_to_string(list_sort(list_distinct({_CODES})), ',') codes from picked_species_enhanced")
def subunit_match(spark, sf_dir):
    t = R.pattern_matches(table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "geographic_notes"), "geographic_notes", PATTERNS)
    return t.select("pick_id", F.concat_ws(",", "codes").alias("codes"))


@query("select code, count(*) n from (select unnest(list_distinct(" + _CODES + ")) code from picked_species_enhanced) group by all")
def regex_theta_join(spark, sf_dir):
    t = R.pattern_matches(table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "geographic_notes"), "geographic_notes", PATTERNS)
    return t.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# Sub-units (range.part) that places stand for, and the parts of each range on its two slopes (the crest on both).
UNITS = [(r"(?i)Cord\. de Tapirón", ["8.1", "8.2", "8.3"]), (r"(?i)Cord\. de Jorumbé", ["9.1", "9.2", "9.3"]), (r"(?i)Montañas de", ["8.3", "9.3"]), (r"(?i)Llanos de", ["1.1"]), (r"(?i)Pen\. de", ["2.1", "2.2"])]
LEFT_PARTS, RIGHT_PARTS = {"8": ["2", "3"], "9": ["2", "3"]}, {"8": ["1", "3"], "9": ["1", "3"]}
_UNITS = " || ".join(f"case when regexp_matches(geographic_notes, '{p}') then {codes} else [] end" for p, codes in UNITS)
_SIDE = lambda side: "list_filter(c, lambda x: " + " and ".join(f"(split_part(x, '.', 1) <> '{g}' or split_part(x, '.', 2) in ({', '.join(repr(p) for p in ps)}))" for g, ps in side.items()) + ")"


@query(f"""with u as (select pick_id, geographic_notes n, list_sort(list_distinct({_UNITS})) c from picked_species_enhanced),
f as (select *, regexp_matches(n, '(?i)vert\\. carib') l, regexp_matches(n, '(?i)vert\\. pac') r, regexp_matches(n, '(?i)ambas vert') b from u)
select pick_id, array_to_string(case when n is null then [] when not b and l and not r then {_SIDE(LEFT_PARTS)} when not b and r and not l then {_SIDE(RIGHT_PARTS)} else c end, ',') units from f""")
def slope_units(spark, sf_dir):
    """Sub-units named in the notes; a note that names one slope only keeps those of that slope."""
    t = R.pattern_matches(table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "geographic_notes"), "geographic_notes", UNITS)
    units = X.sided(F.col("codes"), F.col("geographic_notes"), r"(?i)vert\. carib", r"(?i)vert\. pac", r"(?i)ambas vert", LEFT_PARTS, RIGHT_PARTS)
    return t.select("pick_id", F.concat_ws(",", units).alias("units"))


BANDS = [("low", 0.0, 800.0), ("mid", 600.0, 1800.0), ("high", 1500.0, 4000.0)]


@query("select pick_id, b.name band from picked_species_enhanced join (values ('low', 0, 800), ('mid', 600, 1800), ('high', 1500, 4000)) b(name, lo, hi) on elevation_max_m between lo and hi")
def band_range_join(spark, sf_dir):
    return R.in_bands(table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "elevation_max_m"), "elevation_max_m", BANDS).select("pick_id", "band")


@query("select distinct exp_id, translate(exp_id, ' /-:', '____') slug from experiments")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "experiments").select("exp_id", X.slug("exp_id").alias("slug")).distinct()


@query("select ref_id, 'Especie: ' || species || ' (' || coalesce(family, '') || ')' card from species_reference")
def template_cards(spark, sf_dir):
    return table(spark, sf_dir, "species_reference").select("ref_id", X.filled("Especie: {species} ({family})", {"species": F.col("species"), "family": F.col("family")}).alias("card"))


def best_lines(spark, sf_dir):
    """The habitat line of each scanned note by priorities, with its continuation."""
    t = table(spark, sf_dir, "picked_species_enhanced").filter("habitat_raw is not null")
    return t.select("pick_id", X.best_line("habitat_raw", [r"^(Bosque|Selva)", r"\d{3,4}\s*m"]).alias("line"))


QUERIES["best_lines"] = best_lines


@query(f"""with g as (select pick_id, elevation_min_m - 200 lo, elevation_max_m + 200 hi, coalesce({_heights("habitat_raw")}, []) h from picked_species_enhanced)
select pick_id, case when lo is null or hi is null then null when len(h) = 0 then 0 when len(list_filter(h, lambda x: not x between lo and hi)) = 0 then 2 when len(list_filter(h, lambda x: x between lo and hi)) > 0 then 1 else 0 end plausible from g""")
def elevation_plausibility(spark, sf_dir):
    t = table(spark, sf_dir, "picked_species_enhanced")
    return t.select("pick_id", scored(X.plain_elevations("habitat_raw"), F.col("elevation_min_m"), F.col("elevation_max_m")).alias("plausible"))


@query("select o_orderkey, round(o_totalprice, 2) total, c_name customer, n_name nation from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderdate >= timestamp '1997-01-01'")
def pushed_down_star(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rounded(o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("c_name").alias("customer"), F.col("n_name").alias("nation")), 2)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rounded(t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n")), 2)
