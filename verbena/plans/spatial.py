"""Queries of the spatial and learning operators. Places are derived from customer keys, rasters from arithmetic, on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo as G
from ..operators import ml as M
from ..operators import windows as W
from ..runtime import table
from .evaluation import rounded

QUERIES, ORACLE = {}, {}
RINGS = [(1, "north", [(-86.0, 9.5), (-83.0, 9.5), (-83.0, 11.5), (-86.0, 11.5)]), (2, "south", [(-85.0, 8.0), (-82.5, 8.2), (-83.6, 10.1)]), (3, "isle", [(-84.2, 9.7), (-83.9, 9.7), (-83.9, 10.2), (-84.2, 10.2)])]
GRID = G.Grid(-86.0, 11.5, 0.1, -0.1, nodata=-9999.0)
LAYERS = ["bio_14", "bio_15"]

_POINTS = "p as (select c_custkey id, -86.0 + (c_custkey * 7919 % 3571) * 0.001 lon, 8.0 + (c_custkey * 104729 % 3499) * 0.001 lat from customer)"
_EDGES = ", ".join(f"({i}, '{n}', {j}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for i, n, ring in RINGS for j, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])))
_HITS = f"""{_POINTS.replace('-86.0 + (c_custkey * 7919 % 3571) * 0.001', '(-86.0::double + (c_custkey * 7919 % 3571) * 0.001::double)').replace('8.0 + (c_custkey * 104729 % 3499) * 0.001', '(8.0::double + (c_custkey * 104729 % 3499) * 0.001::double)')},
e(poly_id, name, j, x1, y1, x2, y2) as (values {_EDGES}),
h as (select p.id, e.poly_id, e.name from p, e group by all having sum(case when (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (case when y2 <> y1 then y2 - y1 else 1 end) + x1 then 1 else 0 end) % 2 = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(-86.0) + (k * 7919 % 3571) * 0.001).alias("lon"), (F.lit(8.0) + (k * 104729 % 3499) * 0.001).alias("lat"))


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, [{"x": x, "y": y} for x, y in r]) for i, n, r in RINGS], "poly_id int, name string, ring array<struct<x: double, y: double>>")


#: Layers of the models with the step from column to column in the derived raster.
CLIMATE = {"bio_14": 17, "bio_15": 43, "bio_16": 29, "bio_17": 59, "bio_18": 71, "bio_19": 83}


def pixels(spark: SparkSession, layers: dict[str, int] | None = None) -> DataFrame:
    """A derived raster of 36 x 36 cells; every 37th cell is nodata, cells outside are absent."""
    layers = layers or {x: CLIMATE[x] for x in LAYERS}
    cells = spark.range(36 * 36).select((F.col("id") / 36).cast("int").alias("row"), (F.col("id") % 36).cast("int").alias("col"), "id")
    value = lambda k: F.when(F.col("id") % 37 == 0, -9999.0).otherwise(((F.col("row") * 31 + F.col("col") * k) % 101).cast("double"))
    return cells.select("row", "col", F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), value(k).alias("value")) for x, k in layers.items()))).alias("c")).select("c.layer", "row", "col", "c.value")


@query(f"with {_HITS} select id, poly_id, name from h")
def point_in_polygon(spark, sf_dir):
    return G.polygon_matches(points(spark, sf_dir), polygons(spark), 0.5).select("id", "poly_id", "name")


@query(f"with {_HITS} select p.id, coalesce(arg_min(name, poly_id), 'unknown') name from p left join h using (id) group by all")
def first_polygon(spark, sf_dir):
    return G.first_polygon(points(spark, sf_dir), polygons(spark), "id", 0.5).select("id", "name")


@query(f"with {_HITS} select name, count(*) n, round(count(*) * 100.0 / (select count(*) from p), 6) pct from h group by all order by n desc, name limit 3")
def pct_inside_top3(spark, sf_dir):
    return rounded(G.coverage(points(spark, sf_dir), polygons(spark), 0.5)).orderBy(F.desc("n"), "name").limit(3)


@query(f"with {_HITS} select id from h group by id")
def clip_to_polygons(spark, sf_dir):
    return G.inside(points(spark, sf_dir), polygons(spark), "id", 0.5).select("id")


@query(f"with {_HITS}, c as (select * from p where id % 3 <> 0), q as (select * from p where id % 3 = 0) select c.id, round(min(sqrt((c.lon - q.lon) ** 2 + (c.lat - q.lat) ** 2)), 6) distance from c, q group by c.id having min(sqrt((c.lon - q.lon) ** 2 + (c.lat - q.lat) ** 2)) > 0.1 and min(sqrt((c.lon - q.lon) ** 2 + (c.lat - q.lat) ** 2)) <= 0.4")
def annulus_background(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(G.annulus(p.filter("id % 3 <> 0"), p.filter("id % 3 = 0"), 0.1, 0.4).select("id", "distance"))


_RASTER = """, x as (select id, floor((lat - 11.5::double) / (-0.1)::double)::int r, floor((lon - (-86.0)::double) / 0.1::double)::int c from p),
v as (select id, case when r between 0 and 35 and c between 0 and 35 and (r * 36 + c) % 37 <> 0 then ((r * 31 + c * 17) % 101)::double end bio_14, case when r between 0 and 35 and c between 0 and 35 and (r * 36 + c) % 37 <> 0 then ((r * 31 + c * 43) % 101)::double end bio_15 from x)"""


@query(f"with {_HITS}{_RASTER} select id, bio_14, bio_15 from v")
def raster_sample(spark, sf_dir):
    return G.sampled(points(spark, sf_dir), pixels(spark), GRID, LAYERS).select("id", *LAYERS)


@query(f"with {_HITS}{_RASTER} select id, (id % 3 = 0)::int \"class\", bio_14, bio_15 from v where bio_14 is not null and bio_15 is not null")
def env_matrix(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.environment_matrix(p.filter("id % 3 = 0"), p.filter("id % 3 <> 0"), pixels(spark), GRID, LAYERS).select("id", "class", *LAYERS)


@query("with c as (select (i / 36)::int r0, i from range(1296) t(i)), g as (select i // 36 r, i % 36 c, i from c), z as (select case when (r + c) % 3 = 0 then 'unmatched' when v between 30 and 60 then 'in_band' when v between 20 and 70 then 'outlier_band' else 'out_of_band' end \"zone\" from (select r, c, case when i % 37 = 0 then -9999.0 else (r * 31 + c * 17) % 101 end v from g)) select \"zone\", count(*) n from z group by all")
def habitat_zone_area(spark, sf_dir):
    z = G.zones(pixels(spark).filter("layer = 'bio_14'"), (30.0, 60.0), (20.0, 70.0), (F.col("row") + F.col("col")) % 3 != 0)
    return z.groupBy("zone").agg(F.count("*").alias("n"))


@query(f"with {_HITS}{_RASTER}, w as (select x.id, r, c, dr, dc, ((r + dr) * 31 + (c + dc) * 17) % 101 v from x, range(-7, 8) a(dr), range(-7, 8) b(dc) where r between 7 and 28 and c between 7 and 28) select id, count(*) n, sum(v)::double total, min(v)::double lowest, max(v)::double highest, arg_min(v, (dr, dc))::double \"first\" from w group by all")
def raster_patches(spark, sf_dir):
    """15 x 15 squares of a layer around each place; squares with a missing cell are left out."""
    whole = pixels(spark, {"bio_14": 17}).withColumn("value", ((F.col("row") * 31 + F.col("col") * 17) % 101).cast("double"))
    got = G.patches(points(spark, sf_dir), whole, GRID, "bio_14", 7)
    total = F.aggregate("patch", F.lit(0.0), lambda a, x: a + x)
    return got.select("id", F.size("patch").cast("bigint").alias("n"), total.alias("total"), F.array_min("patch").alias("lowest"), F.array_max("patch").alias("highest"), F.col("patch")[0].alias("first"))


@query(f"""with {_HITS}{_RASTER}, w as (select x.id, dr, dc, case when r + dr between 0 and 35 and c + dc between 0 and 35 and ((r + dr) * 36 + c + dc) % 37 <> 0 then (((r + dr) * 31 + (c + dc) * 17) % 101)::double end v14, case when r + dr between 0 and 35 and c + dc between 0 and 35 and ((r + dr) * 36 + c + dc) % 37 <> 0 then (((r + dr) * 31 + (c + dc) * 43) % 101)::double end v15 from x, range(-7, 8) a(dr), range(-7, 8) b(dc))
select id, id % 5 forest, round(sum(v14) + (count(*) - count(v14)) * avg(v14), 6) total_14, round(sum(v15) + (count(*) - count(v15)) * avg(v15), 6) total_15 from w group by all having count(v14) > 0 and count(v15) > 0""")
def multimodal_patches(spark, sf_dir):
    """15 x 15 squares of two layers, also over the edge, with missing cells filled by their square's mean, beside a tabular column."""
    got = G.patch_stacks(points(spark, sf_dir).withColumn("forest", F.col("id") % 5), pixels(spark), GRID, LAYERS, 7)
    total = lambda k: F.aggregate(F.col("stack")[k], F.lit(0.0), lambda a, x: a + x)
    return rounded(got.select("id", "forest", total(0).alias("total_14"), total(1).alias("total_15")))


_CENTRES = f"g as (select i // 36 r, i % 36 c, -86.0::double + (i % 36 + 0.5::double) * 0.1::double lon, 11.5::double + (i // 36 + 0.5::double) * (-0.1::double) lat from range(1296) t(i)), e(poly_id, name, j, x1, y1, x2, y2) as (values {_EDGES}), k as (select r, c from g, e group by r, c, poly_id having sum(case when (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (case when y2 <> y1 then y2 - y1 else 1 end) + x1 then 1 else 0 end) % 2 = 1)"


@query(f"with {_CENTRES} select r::int as \"row\", c::int as col, layer, case when (r * 36 + c) % 37 = 0 then -9999.0 else ((r * 31 + c * f) % 101) end::double as \"value\" from (select distinct r, c from k), (values ('bio_14', 17), ('bio_15', 43)) l(layer, f)")
def clipped_raster(spark, sf_dir):
    """A raster cut to the polygons: the pixels whose centres lie inside."""
    return G.pixels_inside(pixels(spark), GRID, polygons(spark), 0.5)


@query(f"with {_HITS}, n as (select name, count(*) n from h group by all), o as (select *, row_number() over (order by n desc, name) i from n) select 'areas' layer, round((select sum(n) from n) * 100.0 / (select count(*) from p), 2)::double pct, string_agg(name || ' (' || n || ' reg)', ', ' order by i) names from o where i <= 3 union all select 'isle', round((select count(*) from h where poly_id = 3) * 100.0 / (select count(*) from p), 2)::double, 'isle (' || (select count(*) from h where poly_id = 3) || ' reg)'")
def conservation_layers(spark, sf_dir):
    """Per layer the percentage of places inside (more than once in overlapping polygons) and the names met most."""
    areas = polygons(spark)
    return G.layer_context(points(spark, sf_dir), {"areas": areas, "isle": areas.filter("poly_id = 3")}, 3, 0.5)


def conservation_text(spark, sf_dir):
    """The layers and heights in words; the rows are those of conservation_layers."""
    areas = polygons(spark)
    p = points(spark, sf_dir).withColumn("alt", F.col("id") % 3000)
    return G.context_text(p, {"areas": areas, "isle": areas.filter("poly_id = 3")}, "alt", 0.5)


QUERIES["conservation_text"] = conservation_text


FEATURES = list(CLIMATE)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of presence and background with six climate layers."""
    p = points(spark, sf_dir)
    return G.environment_matrix(p.filter("id % 3 = 0"), p.filter("id % 3 <> 0"), pixels(spark, CLIMATE), GRID, FEATURES)


def rf_metrics(spark, sf_dir):
    """Accuracy, AUC and confusion counts of a forest of 100 deep trees on held-out places (a stratified fifth)."""
    m = W.stratified_split(_matrix(spark, sf_dir), "class", "id")
    model = M.fit_forest(m.filter("not is_test"), FEATURES, trees=100, depth=30)
    return M.measures(M.predict(model, m.filter("is_test"), FEATURES))


def shap_importance(spark, sf_dir):
    """Mean Shapley contribution and direction per feature, over all places."""
    m = _matrix(spark, sf_dir)
    model = M.fit_forest(m, FEATURES, trees=100, depth=10)
    return M.shap_summary(M.shap_values(model, m, FEATURES, "id"), m, FEATURES, "id")


def limiting_factors(spark, sf_dir):
    """The three features that matter most at each place, with their direction."""
    m = _matrix(spark, sf_dir)
    model = M.fit_forest(m, FEATURES, trees=100, depth=5)
    return M.limiting(M.shap_values(model, m, FEATURES, "id"), FEATURES, "id")


QUERIES["limiting_factors"] = limiting_factors


def uniform_background(spark, sf_dir):
    """As many places inside the polygons as there are customers."""
    n = table(spark, sf_dir, "customer").count()
    return G.uniform_background(spark, n, (-86.0, 8.0, -82.5, 11.5), within=polygons(spark))


def lime_weights(spark, sf_dir):
    """Local weights of six features at the place of the highest score (ties: the first)."""
    m = _matrix(spark, sf_dir)
    model = M.fit_forest(m, FEATURES, trees=100, depth=10)
    best = M.predict(model, m, FEATURES).agg(F.min_by(F.struct(*FEATURES), F.struct(-F.col("score"), F.col("id"))).alias("b")).first().b
    weights = M.lime(model, m, {f: best[f] for f in FEATURES}, FEATURES)
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@query(f"with {_HITS}, c as (select name, count(*) n, round(count(*) * 100.0 / (select count(*) from p), 1) pct from h group by all), t as (select *, row_number() over (order by n desc, name) i from c) select string_agg(name || ' ' || format('{{:.1f}}', pct) || ' %', ', ' order by i) context from t where i <= 3")
def conservation_context(spark, sf_dir):
    top = rounded(G.coverage(points(spark, sf_dir), polygons(spark), 0.5), 1).orderBy(F.desc("n"), "name").limit(3)
    rows = top.select(F.struct(-F.col("n"), "name", F.format_string("%s %.1f %%", "name", "pct").alias("s")).alias("r"))
    return rows.agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list("r")), lambda x: x["s"])).alias("context"))


QUERIES |= {"uniform_background": uniform_background, "lime_weights": lime_weights, "rf_metrics": rf_metrics, "shap_importance": shap_importance}
