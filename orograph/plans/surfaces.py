"""Queries on filled terrain, overview levels, tiles, projected and shared grids and fitted planes, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import masks, pyramid, resample
from orograph.operators.registry import Registry
from orograph.sources import fixtures
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

# Terrain without the cells inside the inner and outer circles of the first zones: holes of many cells.
HOLED = "holed AS (SELECT t.r, t.c, t.z, t.valid AND NOT EXISTS (SELECT 1 FROM zones s WHERE s.zone_id % 61 = 0 AND (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c) <= s.r_outer * s.r_outer) AS valid FROM terrain t)"
LEVELS = "lv AS MATERIALIZED (SELECT k, r >> k AS tr, c >> k AS tc, count(*) AS n, sum(z) AS total, min(z) AS low, max(z) AS high FROM {0}, (SELECT unnest(range(0, 21))::INT AS k) WHERE valid GROUP BY ALL)"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain whose cells inside the outer radius of every 61st zone are invalid."""
    cells = fixtures.terrain(spark, sf_dir)
    zones = fixtures.zones(spark, sf_dir).where("zone_id % 61 = 0").select("r", "c", F.col("r_outer").alias("range_cells"))
    inside = masks.around(cells.select("r", "c"), zones).select("r", "c").distinct().withColumn("gone", F.lit(True))
    return cells.join(inside, ["r", "c"], "left").select("r", "c", "z", (F.col("valid") & F.col("gone").isNull()).alias("valid"))


@query(f"""{with_('terrain', 'zones')}, {HOLED}, {LEVELS.format('holed')}, o AS (SELECT a, b FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)),
    cand AS (SELECT r, c, k, (r >> k) + a AS tr, (c >> k) + b AS tc FROM holed, o, (SELECT unnest(range(0, 12))::INT AS k) WHERE NOT valid),
    got AS (SELECT r, c, k, sum(total / d2) / sum(n / d2) AS z FROM (SELECT x.*, n, total, pow((x.tr + 0.5) * pow(2, k) - 0.5 - r, 2) + pow((x.tc + 0.5) * pow(2, k) - 0.5 - c, 2) AS d2 FROM cand x JOIN lv USING (k, tr, tc)) GROUP BY r, c, k)
    SELECT r, c, round(arg_min(z, k), 6) AS z FROM got GROUP BY r, c""")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights for the invalid cells of terrain with wide holes."""
    return pyramid.filled(holed(spark, sf_dir)).select("r", "c", F.round("z", 6).alias("z"))


@query(f"{with_('terrain')}, {LEVELS.format('terrain')}, top AS (SELECT min(k) AS top FROM (SELECT k FROM lv GROUP BY k HAVING count(*) < 2)) SELECT k AS level, tr, tc, n AS cells, round(total / n, 6) AS mean_z, low AS min_z, high AS max_z FROM lv, top WHERE k BETWEEN 1 AND top")
def overview_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overview levels above the grid, to the one of a single cell."""
    found = pyramid.stacked(pyramid.levels(fixtures.terrain(spark, sf_dir))).where("level > 0")
    return found.select("level", "tr", "tc", F.col("n").alias("cells"), F.round(F.col("total") / F.col("n"), 6).alias("mean_z"), F.col("low").alias("min_z"), F.col("high").alias("max_z"))


# A tile of 8 x 8 pixels over the box of each station's range.
TILES = "px AS (SELECT station_id, i, j, (2 * range_cells + 1) / 8.0::DOUBLE AS step, r - range_cells - 0.5 + (i + 0.5) * (2 * range_cells + 1) / 8.0::DOUBLE AS y, c - range_cells - 0.5 + (j + 0.5) * (2 * range_cells + 1) / 8.0::DOUBLE AS x FROM stations, (SELECT unnest(range(0, 8))::INT AS i), (SELECT unnest(range(0, 8))::INT AS j))"


@query(f"""{with_('terrain', 'stations')}, {LEVELS.format('terrain')}, top AS (SELECT min(k) AS top FROM (SELECT k FROM lv GROUP BY k HAVING count(*) < 2)), {TILES}, spot AS (SELECT *, greatest(0, least(top, floor(log2(step) + 1e-9)))::INT AS k FROM px, top)
    SELECT station_id, i, j, spot.k AS level, round(total / n, 6) AS z FROM spot LEFT JOIN lv ON lv.k = spot.k AND lv.tr = floor(y + 0.5)::INT >> spot.k AND lv.tc = floor(x + 0.5)::INT >> spot.k""")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elevation tile of 8 x 8 pixels over each station's range, every pixel from the one level that its size asks for."""
    found = pyramid.levels(fixtures.terrain(spark, sf_dir))
    step = (2 * F.col("range_cells") + 1) / F.lit(8.0)
    tiles = fixtures.stations(spark, sf_dir).select("station_id", "r", "c", "range_cells", step.alias("step"), pyramid.level_for(step, len(found) - 1).alias("level"))
    pixels = resample.lattice(tiles, F.lit(8), F.lit(8))
    at = lambda v, i: F.floor(F.col(v) - F.col("range_cells") - 0.5 + (F.col(i) + 0.5) * F.col("step") + 0.5).cast("int")
    pixels = pixels.withColumns({"pr": at("r", "i"), "pc": at("c", "j")}).withColumns({"tr": F.expr("shiftright(pr, level)"), "tc": F.expr("shiftright(pc, level)")})
    out = pixels.join(pyramid.stacked(found), ["level", "tr", "tc"], "left")
    return out.select("station_id", "i", "j", "level", F.round(F.col("total") / F.col("n"), 6).alias("z"))


def resampled_at(spark: SparkSession, sf_dir: str, step: float, offset: float) -> DataFrame:
    """The cells of a grid with another step and offset over the terrain, with their places."""
    edge = fixtures.terrain(spark, sf_dir).agg((F.floor((F.max("r") - offset) / step) + 1).cast("int").alias("h"), (F.floor((F.max("c") - offset) / step) + 1).cast("int").alias("w"))  # one row
    return resample.lattice(edge, "h", "w").withColumns({"y": F.col("i") * step + offset, "x": F.col("j") * step + offset})


def resample_sql(step: float, offset: float, having: str) -> str:
    return f"""{with_('terrain')}, g AS (SELECT i, j, i * {step}::DOUBLE + {offset} AS y, j * {step}::DOUBLE + {offset} AS x FROM (SELECT unnest(range(0, floor(((SELECT max(r) FROM terrain) - {offset}) / {step}::DOUBLE)::BIGINT + 1))::INT AS i), (SELECT unnest(range(0, floor(((SELECT max(c) FROM terrain) - {offset}) / {step}::DOUBLE)::BIGINT + 1))::INT AS j)),
    q AS (SELECT i, j, floor(y)::INT + a AS r, floor(x)::INT + b AS c, (CASE WHEN a = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN b = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w, floor(y)::INT + a = floor(y + 0.5)::INT AND floor(x)::INT + b = floor(x + 0.5)::INT AS mid FROM g, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b)),
    m AS (SELECT q.*, t.z FROM q LEFT JOIN terrain t ON t.r = q.r AND t.c = q.c AND t.valid WHERE w > 0)
    SELECT i, j, round(sum(w * z) / sum(w) FILTER (z IS NOT NULL), 6) AS z FROM m GROUP BY i, j HAVING sum(w) FILTER (z IS NOT NULL) > 1e-6 AND {having}"""


@query(resample_sql(2.75, 0.5, "bool_or(mid AND z IS NOT NULL)"))
def resample_any_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain on cells of 2.75 from 0.5 on; a cell whose nearest one is invalid has no value."""
    out = resample.bilinear(resampled_at(spark, sf_dir, 2.75, 0.5), fixtures.terrain(spark, sf_dir), ["i", "j"])
    return out.select("i", "j", F.round("z", 6).alias("z"))


@query(resample_sql(0.75, 0.25, "bool_and(z IS NOT NULL)"))
def resample_all_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain on cells of 0.75, only where all cells that count are valid."""
    out = resample.bilinear(resampled_at(spark, sf_dir, 0.75, 0.25), fixtures.terrain(spark, sf_dir), ["i", "j"], "all")
    return out.select("i", "j", F.round("z", 6).alias("z"))


# The grid lies with its corner at 79 degrees east, 32 north, in cells of 0.005 degrees.
WEST, NORTH, CELL, CENTRAL = 79.0, 32.0, 0.005, 81.0


def lonlat(y: Column, x: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in cells."""
    return WEST + (x + 0.5) * CELL, NORTH - (y + 0.5) * CELL


def _series(coefficients: tuple[float, ...], sign: str, a: str, b: str, c: str, s: str) -> str:
    return "".join(f" {sign} {k!r}::DOUBLE * {c}({2 * j} * {a}) * {s}({2 * j} * {b})" for j, k in enumerate(coefficients, 1))


def utm_sql(lon: str, lat: str, table: str, more: str) -> str:
    """Two CTEs that add east and north to a table."""
    return f"""{table}_t AS (SELECT {more}, radians({lon} - {CENTRAL}) AS lam, sinh(atanh(sin(radians({lat}))) - {S._E!r}::DOUBLE * atanh({S._E!r}::DOUBLE * sin(radians({lat})))) AS t FROM {table}),
{table}_x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM {table}_t),
{table}_utm AS (SELECT * EXCLUDE (lam, t, xi, eta), 500000 + {S._RADIUS!r}::DOUBLE * (eta{_series(S._ALPHA, '+', 'xi', 'eta', 'cos', 'sinh')}) AS east, {S._RADIUS!r}::DOUBLE * (xi{_series(S._ALPHA, '+', 'xi', 'eta', 'sin', 'cosh')}) AS north FROM {table}_x)"""


def back_sql(table: str) -> str:
    """CTEs that add lon and lat to a table with east and north."""
    sine = "tanh(iso)"
    for _ in range(7):
        sine = f"tanh(iso + {S._E!r}::DOUBLE * atanh({S._E!r}::DOUBLE * {sine}))"
    return f"""{table}_p AS (SELECT *, north / {S._RADIUS!r}::DOUBLE AS xi, (east - 500000) / {S._RADIUS!r}::DOUBLE AS eta FROM {table}),
{table}_q AS (SELECT *, xi{_series(S._BETA, '-', 'xi', 'eta', 'sin', 'cosh')} AS gy, eta{_series(S._BETA, '-', 'xi', 'eta', 'cos', 'sinh')} AS gx FROM {table}_p),
{table}_i AS (SELECT *, atanh(sin(gy) / cosh(gx)) AS iso FROM {table}_q),
{table}_ll AS (SELECT * EXCLUDE (xi, eta, gy, gx, iso), {CENTRAL} + degrees(atan2(sinh(gx), cos(gy))) AS lon, degrees(asin({sine})) AS lat FROM {table}_i)"""


@query(f"{with_('stations')}, s AS (SELECT station_id, {WEST} + (c + 0.5::DOUBLE) * {CELL} AS lon0, {NORTH} - (r + 0.5::DOUBLE) * {CELL} AS lat0 FROM stations), {utm_sql('lon0', 'lat0', 's', 'station_id, lon0, lat0')}, {back_sql('s_utm')} SELECT station_id, round(east, 4) AS east, round(north, 4) AS north, round(lon, 9) AS lon, round(lat, 9) AS lat, abs(lon - lon0) < 1e-11 AND abs(lat - lat0) < 1e-11 AS returns FROM s_utm_ll")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations projected and taken back: 1e-11 degrees are a micrometre."""
    lon, lat = lonlat(F.col("r"), F.col("c"))
    there = fixtures.stations(spark, sf_dir).select("station_id", lon.alias("lon0"), lat.alias("lat0"))
    east, north = S.to_utm(F.col("lon0"), F.col("lat0"), CENTRAL)
    there = there.withColumns({"east": east, "north": north})
    lon, lat = S.from_utm(F.col("east"), F.col("north"), CENTRAL)
    back = there.withColumns({"lon": lon, "lat": lat})
    returns = (F.abs(F.col("lon") - F.col("lon0")) < 1e-11) & (F.abs(F.col("lat") - F.col("lat0")) < 1e-11)
    return back.select("station_id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), returns.alias("returns"))


# The shared grid of all stations: the box of their ranges (of 500 m a cell), in cells of 500 m, coarsened to a budget.
METRES, BUDGET = 500, 60_000
SHARED = f"""s AS (SELECT station_id, range_cells, {WEST} + (c + 0.5::DOUBLE) * {CELL} AS lon0, {NORTH} - (r + 0.5::DOUBLE) * {CELL} AS lat0 FROM stations), {utm_sql('lon0', 'lat0', 's', 'station_id, range_cells')},
box AS (SELECT min(east - range_cells * {METRES}) AS left_, max(east + range_cells * {METRES}) AS right_, min(north - range_cells * {METRES}) AS bottom_, max(north + range_cells * {METRES}) AS top_ FROM s_utm),
step AS (SELECT *, list_reduce(list_prepend(CASE WHEN ceil((top_ - bottom_) / {METRES}) * ceil((right_ - left_) / {METRES}) <= {BUDGET} THEN {METRES}::DOUBLE ELSE {METRES} * sqrt(ceil((top_ - bottom_) / {METRES}) * ceil((right_ - left_) / {METRES}) / {BUDGET}::DOUBLE) END, range(1, 65)::DOUBLE[]),
    lambda st, k: CASE WHEN ceil((top_ - bottom_) / st) * ceil((right_ - left_) / st) <= {BUDGET} THEN st ELSE st * sqrt(ceil((top_ - bottom_) / st) * ceil((right_ - left_) / st) / {BUDGET}::DOUBLE) END) AS step FROM box),
g AS (SELECT i, j, left_ + (j + 0.5) * step AS east, top_ - (i + 0.5) * step AS north FROM (SELECT *, unnest(range(0, ceil((top_ - bottom_) / step)::BIGINT))::INT AS i FROM step), LATERAL (SELECT unnest(range(0, ceil((right_ - left_) / step)::BIGINT))::INT AS j)),
{back_sql('g')},
pl AS (SELECT i, j, east, north, ({NORTH} - lat) / {CELL} - 0.5 AS y, (lon - {WEST}) / {CELL} - 0.5 AS x FROM g_ll),
q AS (SELECT i, j, floor(y)::INT + a AS r, floor(x)::INT + b AS c, (CASE WHEN a = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN b = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w, floor(y)::INT + a = floor(y + 0.5)::INT AND floor(x)::INT + b = floor(x + 0.5)::INT AS mid FROM pl, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b)),
m AS (SELECT q.*, t.z FROM q JOIN terrain t ON t.r = q.r AND t.c = q.c AND t.valid WHERE w > 0),
shared AS (SELECT i, j, sum(w * z) / sum(w) AS z FROM m GROUP BY i, j HAVING sum(w) > 1e-6 AND bool_or(mid))"""


def shared_box(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stations in metres (station_id, range_cells, east, north), and the one row of their shared grid: edges and step."""
    lon, lat = lonlat(F.col("r"), F.col("c"))
    east, north = S.to_utm(lon, lat, CENTRAL)
    sites = fixtures.stations(spark, sf_dir).select("station_id", "range_cells", east.alias("east"), north.alias("north"))
    reach = F.col("range_cells") * METRES
    box = sites.agg(F.min(F.col("east") - reach).alias("left_"), F.max(F.col("east") + reach).alias("right_"), F.min(F.col("north") - reach).alias("bottom_"), F.max(F.col("north") + reach).alias("top_"))
    height, width = F.col("top_") - F.col("bottom_"), F.col("right_") - F.col("left_")
    native = F.ceil(height / METRES) * F.ceil(width / METRES)
    return sites, box.withColumn("step", resample.within(native, height, width, F.lit(float(METRES)), BUDGET))


def shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain on the shared grid: (i, j, east, north, z) of its cells that have a value."""
    _, box = shared_box(spark, sf_dir)
    rows, columns = F.ceil((F.col("top_") - F.col("bottom_")) / F.col("step")).cast("int"), F.ceil((F.col("right_") - F.col("left_")) / F.col("step")).cast("int")
    cells = resample.lattice(box, rows, columns).select("i", "j", (F.col("left_") + (F.col("j") + 0.5) * F.col("step")).alias("east"), (F.col("top_") - (F.col("i") + 0.5) * F.col("step")).alias("north"))
    lon, lat = S.from_utm(F.col("east"), F.col("north"), CENTRAL)
    placed = cells.withColumns({"lon": lon, "lat": lat}).withColumns({"y": (NORTH - F.col("lat")) / CELL - 0.5, "x": (F.col("lon") - WEST) / CELL - 0.5})
    # Cells off the terrain are left out before they ask for their corners.
    edge = F.broadcast(fixtures.terrain(spark, sf_dir).agg(F.max("r").alias("max_r"), F.max("c").alias("max_c")))  # one row
    placed = placed.join(edge).where("y > -1 and x > -1 and y < max_r + 1 and x < max_c + 1")
    return resample.bilinear(placed, fixtures.terrain(spark, sf_dir), ["i", "j", "east", "north"])


@query(f"{with_('terrain', 'stations')}, {SHARED} SELECT i, j, round(z, 5) AS z FROM shared")
def shared_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain projected to metres and resampled onto the one grid that holds the ranges of all stations."""
    return shared_cells(spark, sf_dir).select("i", "j", F.round("z", 5).alias("z"))


@query(f"""{with_('terrain', 'stations')}, {SHARED}, spot AS (SELECT s.i, s.j, g.east, g.north FROM shared s JOIN g USING (i, j)),
    n AS (SELECT i, j, count(*) AS n FROM spot JOIN s_utm u ON (u.east - spot.east) * (u.east - spot.east) + (u.north - spot.north) * (u.north - spot.north) <= (u.range_cells * {METRES})::DOUBLE * (u.range_cells * {METRES}) GROUP BY i, j)
    SELECT round(any_value(step), 6) AS step, (SELECT count(*) FROM shared) AS cells, count(*) AS covered, count(*) FILTER (n >= 2) AS overlap, max(n) AS most FROM n, step""")
def shared_grid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of the shared grid, its cells, and how many of them one or more stations reach."""
    sites, box = shared_box(spark, sf_dir)
    cells = shared_cells(spark, sf_dir)
    # Stations and cells meet on squares as wide as the longest range.
    wide = 64 * METRES
    square = lambda v: F.floor(v / wide)
    reach = F.col("range_cells") * METRES
    spread = sites.withColumn("be", F.explode(F.sequence(square(F.col("east") - reach), square(F.col("east") + reach)))).withColumn("bn", F.explode(F.sequence(square(F.col("north") - reach), square(F.col("north") + reach))))
    spread = spread.withColumnsRenamed({"east": "site_east", "north": "site_north"})
    met = cells.withColumns({"be": square(F.col("east")), "bn": square(F.col("north"))}).join(spread, ["be", "bn"])
    de, dn = F.col("site_east") - F.col("east"), F.col("site_north") - F.col("north")
    n = met.where(de * de + dn * dn <= reach.cast("double") * reach).groupBy("i", "j").agg(F.count("*").alias("n"))
    found = n.agg(F.count("*").alias("covered"), F.count_if(F.col("n") >= 2).alias("overlap"), F.max("n").alias("most"))
    return box.select(F.round("step", 6).alias("step")).join(F.broadcast(cells.agg(F.count("*").alias("cells")))).join(F.broadcast(found))  # one row each


@query(f"""{with_('terrain')}, m AS (SELECT r // 16 AS tr, c // 16 AS tc, avg((r % 16)::DOUBLE) AS mr, avg((c % 16)::DOUBLE) AS mc, avg(z) AS mz, count(*) AS n FROM terrain WHERE valid GROUP BY ALL),
    d AS (SELECT tr, tc, n, mz, r % 16 - mr AS x, c % 16 - mc AS y, z - mz AS v FROM terrain t JOIN m ON m.tr = t.r // 16 AND m.tc = t.c // 16 WHERE valid),
    f AS (SELECT tr, tc, n, any_value(mz) AS mz, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * v) AS xz, sum(y * v) AS yz FROM d GROUP BY ALL),
    p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM f WHERE xx * yy - xy * xy > 0.5)
    SELECT p.tr::INT AS tr, p.tc::INT AS tc, p.n AS cells, round(a, 4) AS slope_r, round(b, 4) AS slope_c, round(any_value(p.mz), 6) AS centre_z, round(degrees(atan(sqrt(a * a + b * b) / 10)), 4) AS slope_deg, round(sqrt(avg((v - a * x - b * y) * (v - a * x - b * y))), 4) AS rmse, round(max(abs(v - a * x - b * y)), 4) AS largest
    FROM p JOIN d ON d.tr = p.tr AND d.tc = p.tc GROUP BY p.tr, p.tc, p.n, a, b""")
def plane_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane through the valid cells of each square of 16, with its slope over cells of 10 m, the root mean square of what it leaves and the largest of it."""
    keys = ["tr", "tc"]
    cells = fixtures.terrain(spark, sf_dir).where("valid").select(F.floor(F.col("r") / 16).cast("int").alias("tr"), F.floor(F.col("c") / 16).cast("int").alias("tc"), (F.col("r") % 16).cast("double").alias("x"), (F.col("c") % 16).cast("double").alias("y"), "z")
    return planes(cells, keys, 10.0).select(
        *keys, "cells", F.round("a", 4).alias("slope_r"), F.round("b", 4).alias("slope_c"), F.round("centre_z", 6).alias("centre_z"),
        F.round("slope_deg", 4).alias("slope_deg"), F.round("rmse", 4).alias("rmse"), F.round("largest", 4).alias("largest"),
    )


def planes(points: DataFrame, keys: list[str], unit: float = 1.0) -> DataFrame:
    """The least-squares plane of each group of points (keys, x, y, z): slopes a and b, height at the middle, slope in degrees, rmse and largest residual.

    First the means, then the moments about them, then the residuals, so that far
    coordinates cost no digits. Groups without an area have no plane.
    """
    means = points.groupBy(*keys).agg(F.count("*").alias("cells"), *(F.avg(v).alias(f"m{v}") for v in "xyz"))
    near = points.join(means, keys).select(*keys, "cells", F.col("mz").alias("centre_z"), *((F.col(v) - F.col(f"m{v}")).alias(v) for v in "xyz"))
    sums = near.groupBy(*keys).agg(*(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "yy", "xy", "xz", "yz")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    fit = sums.where(det > 0.5).select(*keys, ((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).alias("a"), ((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det).alias("b"))
    left = near.join(fit, keys).withColumn("left", F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y"))
    slope = F.degrees(F.atan(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / unit))
    out = left.groupBy(*keys, "cells", "centre_z", "a", "b").agg(F.sqrt(F.avg(F.col("left") * F.col("left"))).alias("rmse"), F.max(F.abs("left")).alias("largest"))
    return out.withColumn("slope_deg", slope)
