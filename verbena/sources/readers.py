"""Scans of text, delimited, JSON, spatial and binary files; every schema is declared, none is inferred."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.geo import Grid

#: Tables of the warehouse.
EXPERIMENTS = "exp_id string, persona string, n_species int, started_at string, status string, notes string"
LLM_EVALUATIONS = "exp_id string, especie string, tier string, perfil string, modelo_generador string, stratum string, m1 float, m2 float, m3 float, m4 float, m5 float, score_compuesto float, taxonomy_valid int, disagree_flag int, needs_human_review int, synced_at string"
HUMAN_EVALUATIONS = "exp_id string, especie string, tier string, modelo_generador string, evaluator string, m1 int, m2 int, m3 int, m4 int, m5 int, comment_text string, submitted_at string"
EXPERT_SESSIONS = "username string, model_a string, model_b string, created_at string"
SCHEMAS = {"experiments": EXPERIMENTS, "llm_evaluations": LLM_EVALUATIONS, "human_evaluations": HUMAN_EVALUATIONS, "expert_sessions": EXPERT_SESSIONS}


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", strict: bool = False) -> DataFrame:
    """Quoted CSV with a header; fields may hold line breaks. Bad rows are dropped unless ``strict``."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', sep=sep, mode="FAILFAST" if strict else "DROPMALFORMED", enforceSchema=False).csv(path)


def tsv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated dump, one record a line so that files split; unreadable lines are dropped, columns pruned."""
    df = spark.read.schema(schema).options(header=True, sep="\t", mode="DROPMALFORMED", quote="").csv(path)
    return df.select(*columns) if columns else df


def ragged(spark: SparkSession, path: str, skip: Sequence[str] = ("=", "-")) -> DataFrame:
    """(first, last) token of each line of a table laid out with runs of two spaces or tabs; banner lines start with any of ``skip``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    for s in skip:
        lines = lines.filter(~F.col("value").startswith(s))
    parts = F.split(F.trim("value"), r"\s{2,}|\t")
    return lines.select(F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"), F.size(parts).alias("n")).filter("n >= 2").drop("n")


def line_list(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(value): trimmed lines that are neither blank nor comments."""
    v = F.trim("value")
    df = spark.read.text(path).select(v.alias("value")).filter("value <> ''")
    return df if comment is None else df.filter(~F.col("value").startswith(comment))


@contextmanager
def small_files(spark: SparkSession, cost: int = 64 << 10) -> Iterator[None]:
    """What is run inside reads many files a task; by Spark's own cost of opening a file, a task has four or so."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(cost))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _below(pattern: str | None) -> dict[str, object]:
    """Options by which a path is a folder whose files of that pattern are read: folders are listed in parallel, files not one by one as by a path with stars."""
    return {} if pattern is None else {"recursiveFileLookup": True, "pathGlobFilter": pattern}


def document_name(path: Column, suffix: str = ".json") -> Column:
    """The name under which ``sinks.documents`` wrote a file."""
    name = F.regexp_extract(path, "/doc-([^/]*)$", 1)
    return F.url_decode(F.url_decode(F.substring(name, F.lit(1), F.length(name) - len(suffix))))


def json_documents(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """One row per JSON document, with its path; no rows where no file is. With a pattern, path is a folder."""
    try:
        docs = spark.read.schema(schema).options(multiLine=True, mode="PERMISSIVE", **_below(pattern)).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("path", F.lit(None).cast("string"))
    return docs.withColumn("path", F.col("_metadata.file_path"))


def json_log(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, key, value variant): a document whose top level is a map from keys to values of any type. With a pattern, path is a folder."""
    docs = spark.read.options(**_below(pattern)).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    docs = docs.filter(F.schema_of_variant("doc").startswith("OBJECT"))
    docs.createOrReplaceTempView("__verbena_log")
    return spark.sql("select d.path, e.key, e.value from __verbena_log d, lateral variant_explode(d.doc) e")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, parent, modified, size) of all files below a folder; contents are not read."""
    try:
        df = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, name string, parent string, modified timestamp, size bigint")
    parts = F.split("path", "/")
    return df.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def geojson(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(poly_id, name, ring, holes): the polygons of feature collections; parts of multipolygons are rows of their own."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("i", "f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(F.array(one))
    rows = f.select("i", F.col("f.properties").getItem(name).alias("name"), F.posexplode(parts).alias("k", "rings"))
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select(F.concat_ws("-", "i", "k").alias("poly_id"), "name", F.get(rings, F.lit(0)).alias("ring"), F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes")).filter("ring is not null")


def ascii_grid(spark: SparkSession, path: str, layer: str) -> tuple[DataFrame, Grid]:
    """(layer, row, col, value) and the header of a raster in the text format of grids (ncols, nrows, xllcorner, yllcorner, cellsize, nodata_value, then the rows from north to south)."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("ls"))
    heads = lines.select(F.explode(F.filter("ls", lambda x: x.rlike(r"^\s*[A-Za-z]"))).alias("h")).collect()  # six lines
    head = {k.lower(): float(v) for k, v in (r.h.split() for r in heads)}
    size = head["cellsize"]
    grid = Grid(head["xllcorner"], head["yllcorner"] + head["nrows"] * size, size, -size, head.get("nodata_value"))
    rows = lines.select(F.posexplode(F.filter("ls", lambda x: x.rlike(r"^\s*[-+.0-9]"))).alias("row", "line"))
    cells = rows.select(F.lit(layer).alias("layer"), "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    return cells.select("layer", "row", "col", F.col("v").cast("double").alias("value")), grid


def shapefile(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(poly_id, name, ring, holes): the polygons of .shp files with the names of a column of the .dbf beside them. Outer rings run clockwise; a file is read by one task."""
    point = "struct<x: double, y: double>"
    both = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    files_ = both.filter("kind in ('shp', 'dbf')").groupBy("stem").agg(*(F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for stem, shp, dbf in zip(pdf["stem"], pdf["shp"], pdf["dbf"]):
                names = _dbf_column(dbf, name) if dbf is not None else []
                rows = [(f"{stem.rsplit('/', 1)[-1]}-{i}-{k}", names[i] if i < len(names) else None, ring, holes) for i, parts in enumerate(_shp_polygons(shp)) for k, (ring, holes) in enumerate(parts)]
                yield pd.DataFrame(rows, columns=["poly_id", "name", "ring", "holes"])

    return files_.filter("shp is not null").mapInPandas(run, f"poly_id string, name string, ring array<{point}>, holes array<array<{point}>>")


def _shp_polygons(data: bytes) -> Iterator[list[tuple[list[dict], list[list[dict]]]]]:
    """Per record its polygons: outer ring and holes."""
    at = 100
    while at + 12 <= len(data):
        (words,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        polygons: list[tuple[list[dict], list[list[dict]]]] = []
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            xy = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            for s, e in zip(starts, starts[1:]):
                ring = [(xy[2 * i], xy[2 * i + 1]) for i in range(s, e)]
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
                points = [{"x": x, "y": y} for x, y in ring]
                if area > 0 and polygons:  # counter-clockwise: a hole of the ring before
                    polygons[-1][1].append(points)
                else:
                    polygons.append((points, []))
        yield polygons


def _dbf_column(data: bytes, name: str) -> list[str | None]:
    n, head, size = struct.unpack("<iHH", data[4:12])
    at, place = 1, None
    for i in range(32, head - 1, 32):
        title, width = data[i : i + 11].split(b"\0")[0].decode("ascii", "replace"), data[i + 16]
        if title.lower() == name.lower():
            place = (at, at + width)
        at += width
    if place is None:
        return []
    return [data[head + k * size + place[0] : head + k * size + place[1]].decode("utf-8", "replace").strip() or None for k in range(n)]


def zip_members(spark: SparkSession, path: str, suffix: str = "", part: str = "") -> DataFrame:
    """(path, member, content) of the archives' members whose names end and contain as asked; one archive is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(suffix) and part in m and not m.endswith("/"):
                            yield pd.DataFrame({"path": [p], "member": [m], "content": [z.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table kept in code."""
    return spark.createDataFrame(list(rows), schema)


def occurrences(df: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """Landed occurrence records with coordinates inside a box (lon min, lat min, lon max, lat max), each place once."""
    x0, y0, x1, y1 = box
    got = df.filter(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1)).dropDuplicates(["species", "lon", "lat"])
    return got if limit is None else got.limit(limit)


def facets(df: DataFrame, key: str, offset: int, limit: int, at_least: int = 1) -> DataFrame:
    """(key, n): one page of the counts per key, the most frequent first (ties by key)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    return counts.orderBy(F.desc("n"), key).offset(offset).limit(limit)


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()
