"""Readers and sinks as round trips: a table is written in a format and read back, and must be the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geo as G
from ..operators import judging as J
from ..runtime import materialise, run_folder, table
from ..sources import readers, sinks
from .evaluation import rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "picked_species_enhanced").select("pick_id", "species", "habitat_raw").filter("habitat_raw is not null and species is not null")


_SAME = "select pick_id, nullif(species, '') species, habitat_raw from picked_species_enhanced where habitat_raw is not null and habitat_raw <> '' and species is not null"


@query(_SAME)
def csv_round_trip(spark, sf_dir):
    """CSV with line breaks in its fields; a CSV does not tell empty from missing, so empty texts come back as null."""
    path = _place(spark, "csv")
    sinks.csv(_species(spark, sf_dir), path)
    return readers.csv(spark, path, "pick_id bigint, species string, habitat_raw string").filter("habitat_raw is not null")


@query("select exp_id, persona, status from experiments union all select exp_id, persona, status from experiments where status = 'done'")
def csv_appended(spark, sf_dir):
    """Rows appended to a CSV that is there."""
    path = _place(spark, "csv")
    t = table(spark, sf_dir, "experiments").select("exp_id", "persona", "status")
    sinks.csv(t, path)
    sinks.csv(t.filter("status = 'done'"), path, append=True)
    return readers.csv(spark, path, "exp_id string, persona string, status string")


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate is not null")
def tsv_scan(spark, sf_dir):
    """A tab-separated dump, two of its columns never read."""
    path = _place(spark, "tsv")
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate").write.option("sep", "\t").option("header", True).csv(path)
    return readers.tsv(spark, path, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("select p_name as \"first\", p_brand as \"last\" from part")
def ragged_table(spark, sf_dir):
    """First and last field of a table laid out with runs of blanks, banner lines left out."""
    path = _place(spark, "ragged")
    t = table(spark, sf_dir, "part")
    lines = t.select(F.concat(F.lit("  "), "p_name", F.lit("    "), F.col("p_size").cast("string"), F.lit("\t"), "p_brand").alias("value"))
    lines.unionByName(spark.createDataFrame([("=====",), ("-- p_name",), ("",)], "value string")).write.text(path)
    return readers.ragged(spark, path)


@query("select distinct species as \"value\" from species_reference where species is not null and trim(species) <> ''")
def line_list(spark, sf_dir):
    """A list of one name a line, with comments and blank lines."""
    path = _place(spark, "lines")
    t = table(spark, sf_dir, "species_reference").filter("species is not null and trim(species) <> ''").select(F.concat(F.lit("  "), "species", F.lit(" ")).alias("value")).distinct()
    t.unionByName(spark.createDataFrame([("# comment",), ("   ",)], "value string")).write.text(path)
    return readers.line_list(spark, path)


@query("select pick_id, species, habitat_raw from picked_species_enhanced where habitat_raw is not null and species is not null")
def json_round_trip(spark, sf_dir):
    """JSON lines written, and read as documents with their schema."""
    path = _place(spark, "json")
    sinks.json_lines(_species(spark, sf_dir), path)
    return spark.read.schema("pick_id bigint, species string, habitat_raw string").json(path)


@query("select exp_id, count(*) n from (select distinct exp_id, persona from experiments where persona is not null) group by all")
def json_documents(spark, sf_dir):
    """One JSON document per file, found by its pattern; and a log document whose keys are data."""
    path = _place(spark, "docs")
    t = table(spark, sf_dir, "experiments").filter("persona is not null").select("exp_id", "persona").distinct()
    one = t.groupBy("exp_id").agg(F.to_json(F.struct("exp_id", F.min("persona").alias("persona"))).alias("doc"), F.to_json(F.map_from_entries(F.collect_set(F.struct("persona", F.lit(1))))).alias("log"))
    one, log = materialise(one, "json-documents"), _place(spark, "log")
    sinks.documents(one, path, "exp_id", "doc")
    sinks.documents(one, log, "exp_id", "log")
    with readers.small_files(spark):
        keys = materialise(readers.json_log(spark, log, "*.json").select(readers.document_name(F.col("path")).alias("exp_id"), "key"), "json-keys")
        docs = materialise(readers.json_documents(spark, path, "exp_id string, persona string", "*.json").select("exp_id").distinct(), "json-found")
    return keys.join(docs, "exp_id", "left_semi").groupBy("exp_id").agg(F.count("*").alias("n"))


@query("select tier, count(*) n from (select distinct tier, especie from llm_evaluations where tier is not null and especie is not null) group by all")
def partitioned_once(spark, sf_dir):
    """A table written by partitions unless it is there: the second write does nothing."""
    path = _place(spark, "once")
    t = table(spark, sf_dir, "llm_evaluations").filter("tier is not null and especie is not null").select("tier", "especie").distinct()
    sinks.parquet_once(t, path, ["tier"])
    sinks.parquet_once(t.limit(0), path, ["tier"])
    return spark.read.schema("especie string, tier string").parquet(path).groupBy("tier").agg(F.count("*").alias("n"))


@query("select tier, count(*) n from (select distinct tier, eval_id from llm_evaluations where tier is not null) group by all order by tier")
def markdown_report(spark, sf_dir):
    """A report as a markdown table, read back."""
    t = table(spark, sf_dir, "llm_evaluations").filter("tier is not null").select("tier", "eval_id").distinct().groupBy("tier").agg(F.count("*").alias("n"))
    lines = spark.createDataFrame([(x,) for x in sinks.markdown(t).split("\n")[2:] if x], "line string")
    cells = F.split("line", r"\|")
    return lines.select(F.trim(F.get(cells, F.lit(1))).alias("tier"), F.trim(F.get(cells, F.lit(2))).cast("bigint").alias("n"))


@query("select 'Especie: ' || species || ' / ' || coalesce(family, '') as \"value\" from species_reference")
def text_cards(spark, sf_dir):
    """One text per row, written and read."""
    path = _place(spark, "cards")
    sinks.text_cards(table(spark, sf_dir, "species_reference"), path, "Especie: %s / %s", ["species", "family"])
    return spark.read.text(path)


@query("select username, model_a from expert_sessions")
def created_table(spark, sf_dir):
    """A table created if it is not there, filled once."""
    name = f"verbena_{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.create_table(spark, name, "username string, model_a string")
    table(spark, sf_dir, "expert_sessions").select("username", "model_a").write.insertInto(name)
    got = materialise(spark.table(name), "created")
    spark.sql(f"drop table {name}")
    return got


@query("select 'EXP-20250110-' || lpad((1 + coalesce(max(i) filter (where i = c), 0))::varchar, 3, '0') || '-mixed' run_id from (select c, row_number() over (order by c) i from (select distinct try_cast(split_part(exp_id, '-', 3) as bigint) c from experiments where regexp_matches(exp_id, '^EXP-20250110-[0-9]+-')) where c >= 1)")
def allocated_run(spark, sf_dir):
    """The next run id of a day: the first number that is free."""
    return sinks.allocated(table(spark, sf_dir, "experiments"), "20250110", "mixed")


@query("select split_part(file_name, '/', 1) parent, count(distinct file_name) n from raw_records where file_name is not null group by all")
def found_files(spark, sf_dir):
    """Files below a folder, counted by the folder they stand in."""
    path = _place(spark, "tree")
    t = table(spark, sf_dir, "raw_records").filter("file_name is not null").select(F.split_part("file_name", F.lit("/"), F.lit(1)).alias("parent"), "file_name").distinct()
    t.select("parent", F.regexp_replace("file_name", "/", "_").alias("name"), F.lit("x").alias("value")).write.partitionBy("parent", "name").text(path)
    found = readers.files(spark, path, "*.txt").select(F.regexp_extract("path", "parent=([^/]*)/", 1).alias("parent"), F.regexp_extract("path", "name=([^/]*)/", 1).alias("name")).distinct()
    return found.groupBy("parent").agg(F.count("*").alias("n"))


MARKER = "[RESPUESTA]"


@query("select replace(especie, '_', ' ') especie, tier, min(perfil) question, 'Crece en ' || especie answer, 'ficha de ' || especie ground from (select distinct especie, tier, perfil from llm_evaluations where tier in ('T0', 'T1', 'T3') and regexp_matches(especie, '^[A-Z][a-z]+ [a-z]+$') and perfil is not null) group by all")
def run_directory(spark, sf_dir):
    """A run's folder (species / tier / profile files, and a ground text per species) read as items to evaluate."""
    path = _place(spark, "run")
    t = table(spark, sf_dir, "llm_evaluations").filter("tier in ('T0', 'T1', 'T3') and perfil is not null").filter(F.col("especie").rlike("^[A-Z][a-z]+ [a-z]+$"))
    t = t.groupBy("especie", "tier").agg(F.min("perfil").alias("perfil")).withColumn("sp", F.translate("especie", " ", "_"))
    body = F.concat(F.lit("Modelo: m\nPregunta Usuario: "), "perfil", F.lit(f"\n{MARKER}\nCrece en "), "especie")
    pages = t.select("sp", "tier", F.lit("llm_profile_m").alias("file"), body.alias("value"))
    cards = t.select("sp", F.lit("T0").alias("tier"), F.lit("x_ficha").alias("file"), F.concat(F.lit("ficha de "), "especie").alias("value")).distinct()
    files = pages.unionByName(cards)
    files.write.partitionBy("sp", "tier", "file").option("lineSep", "\x03").text(path)
    texts = readers.texts(spark, path + "/*/*/*/*.txt").select(F.regexp_replace(F.regexp_replace("path", "(sp|tier|file)=", ""), "/part-[^/]*$", ".txt").alias("path"), F.regexp_replace("text", "\x03", "").alias("text"))
    items = J.directory_items(texts, "llm_profile_", "_ficha", MARKER)
    return items.select("especie", "tier", "question", "answer", "ground")


@query("select c_custkey id, (case when x > 1 and x < 9 and y > 1 and y < 9 and not (x > 4 and x < 6 and y > 4 and y < 6) then 'ring' end) name from (select c_custkey, (c_custkey * 7919 % 1000) / 100.0 x, (c_custkey * 104729 % 1000) / 100.0 y from customer) where x > 1 and x < 9 and y > 1 and y < 9 and not (x > 4 and x < 6 and y > 4 and y < 6)")
def geojson_holes(spark, sf_dir):
    """Points inside a polygon with a hole, read from GeoJSON."""
    path = _place(spark, "geojson")
    square = lambda a, b: f"[[{a},{a}],[{b},{a}],[{b},{b}],[{a},{b}],[{a},{a}]]"
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"ring"},"geometry":{"type":"Polygon","coordinates":[' + square(1.0005, 8.9995) + "," + square(4.0005, 5.9995) + "]}}]}"
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919 % 1000) / 100.0).alias("lon"), ((k * 104729 % 1000) / 100.0).alias("lat"))
    return G.polygon_matches(points, readers.geojson(spark, path + "/*.txt")).select("id", "name")


@query("select species, round(min(lon), 6) lon, round(min(lat), 6) lat, count(*) n from (select distinct 's' || (c_custkey % 7) species, (c_custkey * 7919 % 3571) * 0.001::double lon, (c_custkey * 104729 % 3499) * 0.001::double lat from customer) where lon between 0.5 and 3 and lat between 0.5 and 3 group by all")
def occurrence_records(spark, sf_dir):
    """Occurrences inside a box, each place once."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (k % 7).cast("string")).alias("species"), ((k * 7919 % 3571) * 0.001).alias("lon"), ((k * 104729 % 3499) * 0.001).alias("lat"))
    got = readers.occurrences(t, (0.5, 0.5, 3.0, 3.0))
    return rounded(got.groupBy("species").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.count("*").alias("n")))


@query("select doc_id, text[:400] section from documents where text is not null and not regexp_matches(text, '(?m)^Hábitat y altitud')")
def sections(spark, sf_dir):
    """A card's section; without its title the first 400 characters (the texts without the title)."""
    t = table(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"(?m)^Hábitat y altitud"))
    return t.select("doc_id", X.section("text", "Hábitat y altitud").alias("section"))
