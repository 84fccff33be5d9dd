"""Points, polygons and rasters as tables.

Polygons are rows (poly_id, name, ring array<struct<x, y>>) and, if they have any, holes (array of rings). Points meet them
by equal grid cells, so only polygons near a point are tested; a large polygon lies in a coarser grid, so that none
falls into more than some CELLS cells. The test counts ray crossings in the JVM. Rasters are pixel tables
(layer, row, col, value) with an affine header, met by equal row and column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import numpy as np
import pandas as pd

from ..runtime import checked_join, materialise

#: Cells of a polygon's box, at most, up to rounding.
CELLS = 1024


def crossings_odd(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: whether a ray from the point to the right crosses the closed ring an odd number of times."""
    n = F.size(ring)

    def crosses(a: Column, i: Column) -> Column:
        b = F.element_at(ring, F.when(i + 1 < n, i + 2).otherwise(1).cast("int"))
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(straddles, b["y"] - a["y"]).otherwise(1.0) + a["x"]
        return straddles & (x < at)

    return F.coalesce(F.size(F.filter(ring, crosses)) % 2 == 1, F.lit(False))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")


def _gridded(polygons: DataFrame, size: float) -> DataFrame:
    """One row per cell of a polygon's box, in the finest grid (cells of size x 2^level) that has few of them."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = polygons.filter(F.size("ring") >= 3).withColumns({"__x0": F.array_min(xs), "__x1": F.array_max(xs), "__y0": F.array_min(ys), "__y1": F.array_max(ys)})
    n = ((F.col("__x1") - F.col("__x0")) / size + 1) * ((F.col("__y1") - F.col("__y0")) / size + 1)
    box = box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(n / CELLS) / 2)).cast("int")).withColumn("__s", F.lit(size) * F.pow(F.lit(2.0), "level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("__s")), F.floor(F.col(hi) / F.col("__s")))
    return box.withColumn("gx", F.explode(span("__x0", "__x1"))).withColumn("gy", F.explode(span("__y0", "__y1")))


def polygon_matches(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """points (.., lon, lat) x polygons: one row per point and polygon that holds it (and no hole of it does), with poly_id and name."""
    if "holes" not in polygons.columns:
        polygons = polygons.withColumn("holes", F.lit(None).cast("array<array<struct<x: double, y: double>>>"))
    grid = materialise(_gridded(polygons, size).select("level", "gx", "gy", "poly_id", "name", "ring", "holes"), "geo-grid")
    levels = sorted(r.level for r in grid.select("level").distinct().collect()) or [0]  # a few: each is twice as coarse as the one before
    near = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__s", F.lit(size) * F.pow(F.lit(2.0), "level"))
    near = near.withColumn("gx", F.floor(F.col("lon") / F.col("__s"))).withColumn("gy", F.floor(F.col("lat") / F.col("__s"))).drop("__s")
    met = checked_join(near, grid, ["level", "gx", "gy"], salt_on=points.columns)
    x, y = F.col("lon"), F.col("lat")
    in_hole = F.coalesce(F.exists("holes", lambda h: crossings_odd(x, y, h)), F.lit(False))
    return met.filter(crossings_odd(x, y, F.col("ring")) & ~in_hole).drop("level", "gx", "gy", "ring", "holes")


def first_polygon(points: DataFrame, polygons: DataFrame, point_id: str, size: float = 1.0, unknown: str = "unknown") -> DataFrame:
    """Each point with the name of the first polygon (by poly_id) that holds it."""
    hits = polygon_matches(points.select(point_id, "lon", "lat"), polygons, size).groupBy(point_id).agg(F.min_by("name", "poly_id").alias("name"))
    return points.join(hits, point_id, "left").withColumn("name", F.coalesce("name", F.lit(unknown)))


def inside(points: DataFrame, polygons: DataFrame, point_id: str, size: float = 1.0) -> DataFrame:
    hits = polygon_matches(points.select(point_id, "lon", "lat"), polygons, size).select(point_id).distinct()
    return points.join(hits, point_id, "left_semi")


def coverage(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """Per polygon name the points inside and their percentage of all points (points in several polygons count in each)."""
    total = points.count()
    hits = polygon_matches(points, polygons, size).groupBy("name").agg(F.count("*").alias("n"))
    return hits.withColumn("pct", F.col("n") * 100.0 / F.lit(max(1, total)))


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def _corners(presences: DataFrame, size: float) -> DataFrame:
    """(px, py, fx, fy): of the places in each cell of a grid, those on their convex hull, which are all that a place outside the cell can be nearest to."""
    keyed = presences.select(F.col("lon").cast("double").alias("px"), F.col("lat").cast("double").alias("py")).na.drop().withColumn("fx", F.floor(F.col("px") / size)).withColumn("fy", F.floor(F.col("py") / size))
    schema = "px double, py double, fx bigint, fy bigint"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(_hull(g[["px", "py"]].to_numpy()), columns=["px", "py"]).assign(fx=fx, fy=fy) for (fx, fy), g in pdf.groupby(["fx", "fy"])]
        return pd.concat(parts) if parts else pdf

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield corners(pdf)

    # Hulls of batches before the shuffle, so that a cell's task gets a few corners per batch.
    return keyed.mapInPandas(partial, schema).groupBy("fx", "fy").applyInPandas(corners, schema)


def annulus(candidates: DataFrame, presences: DataFrame, inner: float, outer: float) -> DataFrame:
    """Candidates further than ``inner`` and at most ``outer`` from the nearest presence; both (id, lon, lat).

    In a fine grid, whose cells are no wider than ``inner``, a candidate that shares its cell with a presence is too near; to
    the others only the corners of a cell's presences can be nearest. These are met in the cells of size ``outer`` around the candidate.
    """
    fine = inner / 2**0.5 if inner > 0 else outer / 8
    corners = materialise(_corners(presences, fine), "geo-corners")
    taken = corners.select("fx", "fy").distinct()
    around = F.explode(F.array(*(F.struct((_cell(F.col("px"), outer) + dx).alias("gx"), (_cell(F.col("py"), outer) + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    grid = materialise(corners.withColumn("g", around).select("px", "py", "g.gx", "g.gy"), "geo-presences")
    near = candidates
    if inner > 0:
        near = near.withColumn("fx", F.floor(F.col("lon") / fine)).withColumn("fy", F.floor(F.col("lat") / fine))
        near = checked_join(near, taken, ["fx", "fy"], "left_anti", salt_on=candidates.columns).drop("fx", "fy")
    near = near.withColumn("gx", _cell(F.col("lon"), outer)).withColumn("gy", _cell(F.col("lat"), outer))
    d = F.sqrt((F.col("lon") - F.col("px")) ** 2 + (F.col("lat") - F.col("py")) ** 2)
    least = checked_join(near, grid, ["gx", "gy"], salt_on=candidates.columns).groupBy(*candidates.columns).agg(F.min(d).alias("distance"))
    return least.filter((F.col("distance") > inner) & (F.col("distance") <= outer))


def uniform_background(session, n: int, box: tuple[float, float, float, float], seed: int = 42, within: DataFrame | None = None, most_tries: int = 1 << 34) -> DataFrame:
    """(id, lon, lat): n places spread evenly over a box (lon min, lat min, lon max, lat max), if asked only inside polygons.

    Places come from the hashes of their numbers, so they are the same on every run; numbers are tried in growing ranges until
    n are inside. It is an error if that takes more than ``most_tries`` numbers: the polygons hardly touch the box.
    """
    x0, y0, x1, y1 = box
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    tries = max(1, n)
    while tries <= most_tries:
        got = session.range(tries).select("id", (x0 + (x1 - x0) * unit(1)).alias("lon"), (y0 + (y1 - y0) * unit(2)).alias("lat"))
        if within is None:
            return got.filter(F.col("id") < n)
        got = materialise(inside(got, within, "id"), "geo-background")
        have = got.count()
        if have >= n:
            return got.orderBy("id").limit(n)
        tries = int(tries * min(64.0, max(2.0, 1.1 * n / max(1, have))))
    raise ValueError(f"fewer than {n} places lie inside the polygons after {most_tries} tries")


@dataclass(frozen=True)
class Grid:
    """Affine header: upper left corner, cell size (dy negative for north-up grids), nodata value."""

    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None = None

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.floor((lat - self.y0) / self.dy).cast("int"), F.floor((lon - self.x0) / self.dx).cast("int")


def sampled(points: DataFrame, pixels: DataFrame, grid: Grid, layers: Sequence[str], below: float | None = None) -> DataFrame:
    """Points with one column per layer: the value of their cell; nodata, values below ``below`` and cells off the grid are null."""
    row, col = grid.place(F.col("lon"), F.col("lat"))
    bad = F.lit(False)
    if grid.nodata is not None:
        bad = bad | (F.col("value") == grid.nodata)
    if below is not None:
        bad = bad | (F.col("value") < below)
    cells = pixels.withColumn("value", F.when(~bad, F.col("value"))).groupBy("row", "col").pivot("layer", list(layers)).agg(F.first("value", ignorenulls=True))
    cells = materialise(cells, "geo-cells")
    return checked_join(points.withColumn("row", row).withColumn("col", col), cells, ["row", "col"], "left", salt_on=points.columns).drop("row", "col")


def pixels_inside(pixels: DataFrame, grid: Grid, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """The pixels whose centres lie inside any polygon: a raster cut to a region."""
    cells = pixels.select("row", "col").distinct()
    centre = cells.select((F.shiftleft(F.col("row").cast("bigint"), 32) + F.col("col")).alias("__cell"), (grid.x0 + (F.col("col") + 0.5) * grid.dx).alias("lon"), (grid.y0 + (F.col("row") + 0.5) * grid.dy).alias("lat"))
    kept = materialise(inside(centre, polygons, "__cell", size).select(F.shiftright("__cell", 32).cast("int").alias("row"), F.col("__cell").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col")), "geo-inside")
    return checked_join(pixels, kept, ["row", "col"], "left_semi")


def layer_context(points: DataFrame, layers: dict[str, DataFrame], top: int = 3, size: float = 1.0) -> DataFrame:
    """(layer, pct, names): of each layer of polygons the percentage of points inside, to two digits, and the names met most often with their numbers.

    Points in several polygons of a layer count in each, so that a percentage may exceed 100. No points: no rows.
    """
    total = points.count()
    out = None
    for name, polygons in layers.items() if total else ():
        hits = polygon_matches(points, polygons, size).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
        hits = materialise(hits, "geo-layer")
        best = hits.orderBy(F.desc("n"), "name").limit(top)
        rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", "n"))).alias("best"))  # top rows
        one = rows.join(hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")), how="cross")  # one row each
        text = F.concat_ws(", ", F.transform("best", lambda b: F.format_string("%s (%d reg)", b["name"], b["n"])))
        got = one.select(F.lit(name).alias("layer"), F.round(F.col("all") * 100.0 / total, 2).alias("pct"), text.alias("names"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else points.sparkSession.createDataFrame([], "layer string, pct double, names string")


def context_text(points: DataFrame, layers: dict[str, DataFrame], altitude: str | None = None, size: float = 1.0) -> DataFrame:
    """One row: the heights and layers of the points in words; without points it says so."""
    head = "ANÁLISIS DE CONSERVACIÓN, POLÍTICA Y TOPOGRAFÍA (Nicho Realizado):\n"
    heights = F.lit("- Datos de altitud no disponibles.\n")
    if altitude is not None:
        r = lambda f: F.round(f(F.col(altitude).cast("double")), 1).cast("string")
        heights = F.coalesce(F.concat(F.lit("- Rango de Altitud: de "), r(F.min), F.lit(" a "), r(F.max), F.lit(" m.s.n.m. (Media: "), r(F.avg), F.lit(" m).\n")), heights)
    one = points.agg(F.count("*").alias("n"), heights.alias("heights"))
    order = F.create_map(*(F.lit(x) for i, name in enumerate(layers) for x in (name, i))) if layers else None
    line = F.when(F.col("pct") > 0, F.concat(F.lit("- "), "layer", F.lit(": El "), F.col("pct").cast("string"), F.lit("% de los registros caen aquí. Principales: "), "names", F.lit(".\n"))).otherwise(F.concat(F.lit("- "), "layer", F.lit(": No hay presencia significativa (0%).\n")))
    lines = layer_context(points, layers, 3, size).select(F.struct(order[F.col("layer")].alias("i") if layers else F.lit(0).alias("i"), line.alias("line")).alias("l")).agg(F.sort_array(F.collect_list("l")).alias("ls"))  # one per layer
    text = F.concat(F.lit(head), "heights", F.array_join(F.transform("ls", lambda x: x["line"]), ""))
    return one.join(lines, how="cross").select(F.when(F.col("n") > 0, text).otherwise("No hay presencias válidas para calcular métricas espaciales.").alias("context"))


def environment_matrix(presences: DataFrame, background: DataFrame, pixels: DataFrame, grid: Grid, layers: Sequence[str]) -> DataFrame:
    """Presences (class 1) and background (class 0), both (id, lon, lat), with all layers; rows with a missing value are dropped."""
    both = presences.select("id", "lon", "lat", F.lit(1).alias("class")).unionByName(background.select("id", "lon", "lat", F.lit(0).alias("class")))
    return sampled(both, pixels, grid, layers).na.drop("any", subset=list(layers))


def patches(points: DataFrame, pixels: DataFrame, grid: Grid, layer: str, half: int) -> DataFrame:
    """Each point's square of (2 half + 1)² values of a layer, row by row; points whose square misses a value are dropped."""
    row, col = grid.place(F.col("lon"), F.col("lat"))
    offsets = F.sequence(F.lit(-half), F.lit(half))
    want = points.withColumn("r", row).withColumn("c", col).withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    want = want.select(*points.columns, "dr", "dc", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    values = pixels.filter(F.col("layer") == layer)
    if grid.nodata is not None:
        values = values.filter(F.col("value") != grid.nodata)
    got = want.join(values.select("row", "col", "value"), ["row", "col"])
    full = got.groupBy(*points.columns).agg(F.sort_array(F.collect_list(F.struct("dr", "dc", "value"))).alias("p")).filter(F.size("p") == (2 * half + 1) ** 2)
    return full.select(*points.columns, F.transform("p", lambda x: x["value"]).alias("patch"))


def patch_stacks(points: DataFrame, pixels: DataFrame, grid: Grid, layers: Sequence[str], half: int) -> DataFrame:
    """Each point's squares of several layers (stack: one array of (2 half + 1)² values per layer, row by row), also over the edge of the grid.

    Missing values take the mean of their square; a point with a square that is missing as a whole is dropped. Other columns stay.
    """
    row, col = grid.place(F.col("lon"), F.col("lat"))
    offsets = F.sequence(F.lit(-half), F.lit(half))
    keyed = materialise(points.withColumn("__id", F.monotonically_increasing_id()), "geo-stack-points")
    want = keyed.select("__id", row.alias("r"), col.alias("c")).withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    want = want.select("__id", "dr", "dc", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    value = F.col("value") if grid.nodata is None else F.when(F.col("value") != grid.nodata, F.col("value"))
    cells = pixels.groupBy("row", "col").agg(F.array(*(F.max(F.when(F.col("layer") == x, value)) for x in layers)).alias("v"))
    got = checked_join(want, materialise(cells, "geo-stack-cells"), ["row", "col"], "left", salt_on=["__id"])
    square = got.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("dr", "dc", "v"))).alias("p"))  # (2 half + 1)² entries

    def filled(k: int) -> Column:
        layer = F.transform("p", lambda x: F.get(x["v"], F.lit(k)))
        there = F.filter(layer, F.isnotnull)
        mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)
        return F.when(F.size(there) > 0, F.transform(layer, lambda x: F.coalesce(x, mean)))

    stack = square.select("__id", F.array(*(filled(k) for k in range(len(layers)))).alias("stack")).filter(F.forall("stack", F.isnotnull))
    return keyed.join(stack, "__id").drop("__id")


def zones(pixels: DataFrame, band: tuple[float, float], outlier: tuple[float | None, float | None], unit: Column) -> DataFrame:
    """Adds zone: unmatched (not in the unit), in_band, outlier_band or out_of_band by the pixel's height ``value``."""
    lo, hi = band
    olo, ohi = (lo if outlier[0] is None else outlier[0]), (hi if outlier[1] is None else outlier[1])
    v = F.col("value")
    return pixels.withColumn("zone", F.when(~F.coalesce(unit, F.lit(False)), "unmatched").when(v.between(lo, hi), "in_band").when(v.between(olo, ohi), "outlier_band").otherwise("out_of_band"))
