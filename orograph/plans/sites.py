"""Queries on requests and results of stations: domains, placements, verdicts, checks and summaries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import bitmaps, resample, shapes
from orograph.operators.registry import Registry
from orograph.plans import visibility
from orograph.sources import fixtures, geojson
from orograph.sources.fixtures import table, with_

REGISTRY = Registry()
query = REGISTRY.query

EDGE = "edge AS (SELECT max(r) AS max_r, max(c) AS max_c FROM terrain)"


def with_edge(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with the last row and column of the grid, one row broadcast."""
    return rows.join(F.broadcast(cells.agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))))


def case(*pairs, otherwise=None) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise) if otherwise is not None else out


WINDOWS = f"{EDGE}, windows AS (SELECT station_id, r, c, range_cells, r - range_cells AS r0, r + range_cells AS r1, c - range_cells AS c0, c + range_cells AS c1, max_r, max_c FROM stations, edge)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each station's range, and the grid's edges."""
    reach = F.col("range_cells")
    sites = fixtures.stations(spark, sf_dir).withColumns({"r0": F.col("r") - reach, "r1": F.col("r") + reach, "c0": F.col("c") - reach, "c1": F.col("c") + reach})
    return with_edge(sites.select("station_id", "r", "c", "range_cells", "r0", "r1", "c0", "c1"), fixtures.terrain(spark, sf_dir))


@query(f"{with_('terrain', 'stations')}, {WINDOWS} SELECT station_id, greatest(r0, 0)::INT AS r0, least(r1, max_r)::INT AS r1, greatest(c0, 0)::INT AS c0, least(c1, max_c)::INT AS c1, greatest(0, least(r1, max_r) - greatest(r0, 0) + 1)::INT AS height, greatest(0, least(c1, max_c) - greatest(c0, 0) + 1)::INT AS width FROM windows")
def window_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    w = windows(spark, sf_dir).withColumns({"r0": F.greatest("r0", zero), "r1": F.least("r1", "max_r"), "c0": F.greatest("c0", zero), "c1": F.least("c1", "max_c")})
    return w.select("station_id", "r0", "r1", "c0", "c1", F.greatest(zero, F.col("r1") - F.col("r0") + 1).alias("height"), F.greatest(zero, F.col("c1") - F.col("c0") + 1).alias("width"))


@query(f"{with_('terrain', 'stations')}, {WINDOWS} SELECT station_id, r BETWEEN 0 AND max_r AND c BETWEEN 0 AND max_c AS site_inside, r0 >= 0 AND c0 >= 0 AND r1 <= max_r AND c1 <= max_c AS box_inside, r0 <= 5 AND r1 >= 2 AND c0 <= 60 AND c1 >= 30 AS meets_box FROM windows")
def bounds_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("r").between(F.lit(0), F.col("max_r")) & F.col("c").between(F.lit(0), F.col("max_c"))
    whole = (F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r1") <= F.col("max_r")) & (F.col("c1") <= F.col("max_c"))
    meets = (F.col("r0") <= 5) & (F.col("r1") >= 2) & (F.col("c0") <= 60) & (F.col("c1") >= 30)
    return windows(spark, sf_dir).select("station_id", inside.alias("site_inside"), whole.alias("box_inside"), meets.alias("meets_box"))


@query(f"{with_('terrain', 'stations')}, {WINDOWS}, u AS (SELECT min(greatest(r0, 0)) AS r0, max(least(r1, max_r)) AS r1, min(greatest(c0, 0)) AS c0, max(least(c1, max_c)) AS c1 FROM windows) SELECT r0::INT AS r0, r1::INT AS r1, c0::INT AS c0, c1::INT AS c1, (r1 - r0 + 1)::BIGINT * (c1 - c0 + 1) AS cells FROM u")
def union_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_clamp(spark, sf_dir)
    u = w.agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    return u.withColumn("cells", (F.col("r1") - F.col("r0") + 1).cast("long") * (F.col("c1") - F.col("c0") + 1))


# Windows are placed on the shared grid of every second cell from its corner; odd offsets do not fit it.
@query(f"{with_('terrain', 'stations')}, {WINDOWS}, u AS (SELECT min(greatest(r0, 0)) AS ur, min(greatest(c0, 0)) AS uc FROM windows) SELECT station_id, ((greatest(r0, 0) - ur) // 2)::INT AS row_offset, ((greatest(c0, 0) - uc) // 2)::INT AS column_offset, (greatest(r0, 0) - ur) % 2 = 0 AND (greatest(c0, 0) - uc) % 2 = 0 AS aligned FROM windows, u")
def window_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = union_grid(spark, sf_dir).select(F.col("r0").alias("ur"), F.col("c0").alias("uc"))
    w = window_clamp(spark, sf_dir).join(F.broadcast(shared))  # one row
    dr, dc = F.col("r0") - F.col("ur"), F.col("c0") - F.col("uc")
    return w.select("station_id", F.floor(dr / 2).cast("int").alias("row_offset"), F.floor(dc / 2).cast("int").alias("column_offset"), ((dr % 2 == 0) & (dc % 2 == 0)).alias("aligned"))


@query(f"""{with_('terrain', 'stations')}, {WINDOWS}, d AS (SELECT station_id, n, x, list_reduce(list_prepend(CASE WHEN n <= 400 THEN 1.0::DOUBLE ELSE sqrt(n / 400.0::DOUBLE) END, range(1, 65)::DOUBLE[]), lambda st, k: CASE WHEN ceil(x / st) * ceil(x / st) <= 400 THEN st ELSE st * sqrt(ceil(x / st) * ceil(x / st) / 400.0::DOUBLE) END) AS scale
    FROM (SELECT *, (2 * range_cells + 1) * (2 * range_cells + 1) AS n, 2 * range_cells + 1 AS x FROM windows)) SELECT station_id, n::INT AS native_cells, round(scale, 6)::DOUBLE AS scale, ceil(x / scale)::INT AS width, ceil(x / scale)::INT * ceil(x / scale)::INT <= 400 AS within FROM d""")
def cell_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each station's box and the coarsening that a budget of 400 asks for, made coarser until it holds."""
    side = 2 * F.col("range_cells") + 1
    rows = fixtures.stations(spark, sf_dir).select("station_id", (side * side).alias("native_cells"), side.cast("double").alias("side"))
    rows = rows.withColumn("scale", resample.within(F.col("native_cells"), F.col("side"), F.col("side"), F.lit(1.0), 400))
    width = F.ceil(F.col("side") / F.col("scale")).cast("int")
    return rows.select("station_id", "native_cells", F.round("scale", 6).alias("scale"), width.alias("width"), (width * width <= 400).alias("within"))


@query(f"{with_('terrain', 'stations')}, {visibility.NEAR}, i AS (SELECT station_id, count(*) AS inside FROM near GROUP BY station_id), a AS (SELECT station_id, count(*) AS whole FROM stations, (SELECT unnest(range(-24, 25)) AS a), (SELECT unnest(range(-24, 25)) AS b) WHERE a * a + b * b <= range_cells * range_cells GROUP BY station_id) SELECT station_id, coalesce(inside, 0) AS inside, whole, round(coalesce(inside, 0) / whole, 6) AS extent_ratio, CASE WHEN coalesce(inside, 0) / whole < 0.5 THEN 'reject' WHEN inside / whole < 0.98 THEN 'warn' ELSE 'ok' END AS state FROM a LEFT JOIN i USING (station_id)")
def extent_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each station's disc lies on the grid; under a half it is rejected, under 0.98 warned of."""
    inside = visibility.near(spark, sf_dir).groupBy("station_id").agg(F.count("*").alias("inside"))
    reach = F.col("range_cells")
    disc = fixtures.stations(spark, sf_dir).select("station_id", "range_cells", F.explode(F.sequence(-reach, reach)).alias("a"))
    # Cells of a row of the disc: twice the half chord, and the middle.
    disc = disc.groupBy("station_id").agg(F.sum((2 * F.floor(F.sqrt((reach * reach - F.col("a") * F.col("a")).cast("double"))) + 1).cast("long")).alias("whole"))
    ratio = F.col("inside") / F.col("whole")
    joined = disc.join(inside, "station_id", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return joined.select("station_id", "inside", "whole", F.round(ratio, 6).alias("extent_ratio"), case((ratio < 0.5, "reject"), (ratio < 0.98, "warn"), otherwise=F.lit("ok")).alias("state"))


RANGES = "ranges AS (SELECT station_id, (range_cells * 10)::DOUBLE AS requested, CASE WHEN station_id % 5 > 0 THEN 40.0::DOUBLE * (1 + station_id % 9) END AS equation FROM stations)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("station_id")
    return fixtures.stations(spark, sf_dir).select(k, (F.col("range_cells") * 10).cast("double").alias("requested"), F.when(k % 5 > 0, 40.0 * (1 + k % 9)).alias("equation"))


@query(f"{with_('stations')}, {RANGES} SELECT station_id, requested, equation, least(requested, equation) AS effective, equation IS NOT NULL AND equation < requested AS limited FROM ranges")
def effective_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = F.coalesce(F.col("equation") < F.col("requested"), F.lit(False))
    return ranges(spark, sf_dir).select("station_id", "requested", "equation", F.least("requested", "equation").alias("effective"), limited.alias("limited"))


@query(f"{with_('stations')}, p AS (SELECT station_id, r, c, range_cells, azimuth_deg, width_deg, CASE WHEN width_deg >= 360 THEN 512 ELSE greatest(16, width_deg // 2) END AS steps FROM stations), v AS (SELECT *, unnest(range(0, steps + 1)) AS i FROM p), a AS (SELECT *, CASE WHEN width_deg >= 360 THEN 360.0::DOUBLE * i / steps ELSE azimuth_deg - width_deg / 2.0::DOUBLE + width_deg::DOUBLE * i / steps END AS az FROM v) SELECT station_id, i::INT AS i, round(c + range_cells * sin(radians(az)), 5) + 0.0 AS x, round(r - range_cells * cos(radians(az)), 5) + 0.0 AS y FROM a")
def range_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each station's range on its arc: a whole circle, or the fan's edge (its centre closes it)."""
    round_ = F.col("width_deg") >= 360
    fan = fixtures.stations(spark, sf_dir).withColumn("steps", F.when(round_, F.lit(512)).otherwise(F.greatest(F.lit(16), F.floor(F.col("width_deg") / 2).cast("int"))))
    fan = fan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    az = F.when(round_, 360.0 * F.col("i") / F.col("steps")).otherwise(F.col("azimuth_deg") - F.col("width_deg") / 2 + F.col("width_deg") * F.col("i") / F.col("steps"))
    fan = fan.withColumn("az", F.radians(az))
    return fan.select("station_id", "i", (F.round(F.col("c") + F.col("range_cells") * F.sin("az"), 5) + 0.0).alias("x"), (F.round(F.col("r") - F.col("range_cells") * F.cos("az"), 5) + 0.0).alias("y"))


# The verdicts and their order.
@query(f"""{with_('terrain', 'stations', 'targets')}, {visibility.PROFILE}, v AS (SELECT p.target_id, p.r0, p.c0, p.r1, p.c1, p.h0, p.h1, first_hit, g.z AS ground1, g.valid AS valid1, s.azimuth_deg, s.width_deg, p.c1 - p.c0 AS dx, p.r0 - p.r1 AS dy, ((p.r1 - p.r0) * (p.r1 - p.r0) + (p.c1 - p.c0) * (p.c1 - p.c0))::DOUBLE AS d2
    FROM pr p JOIN stations s ON s.station_id = p.target_id % (SELECT count(*) FROM stations) LEFT JOIN pa USING (target_id) LEFT JOIN terrain g ON g.r = p.r1 AND g.c = p.c1)
    SELECT target_id, CASE WHEN d2 * 100 + (h1 - h0) * (h1 - h0) > 400 * 400 THEN 'outside_range' WHEN NOT ({visibility.SECTOR}) THEN 'outside_sector' WHEN h1 - h0 < sqrt(d2) * 10 * tan(radians(-10.0)) THEN 'below_min_elevation' WHEN h1 - h0 > sqrt(d2) * 10 * tan(radians(20.0)) THEN 'above_max_elevation' WHEN ground1 IS NULL THEN 'outside_dem' WHEN NOT valid1 THEN 'dem_nodata' WHEN h1 < ground1 THEN 'below_terrain' WHEN first_hit IS NOT NULL THEN 'terrain_blocked' ELSE 'detectable' END AS verdict FROM v""")
def target_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine verdicts of a target as seen from its station, the first that holds."""
    ground = fixtures.terrain(spark, sf_dir).select(F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("z").alias("ground1"), F.col("valid").alias("valid1"))
    beams = fixtures.stations(spark, sf_dir).select("station_id", "azimuth_deg", "width_deg")
    rows = visibility.target_profiles(spark, sf_dir).join(ground, ["r1", "c1"], "left").join(beams, "station_id")
    dx, dy, dh = (F.col("c1") - F.col("c0")).cast("long"), (F.col("r0") - F.col("r1")).cast("long"), F.col("h1") - F.col("h0")
    away = F.sqrt((dx * dx + dy * dy).cast("double")) * 10
    sector = visibility.masks.sector(dx, dy, F.col("azimuth_deg"), F.col("width_deg"))
    verdict = case(
        (away * away + dh * dh > 400 * 400, "outside_range"), (~sector, "outside_sector"),
        (dh < away * F.tan(F.radians(F.lit(-10.0))), "below_min_elevation"), (dh > away * F.tan(F.radians(F.lit(20.0))), "above_max_elevation"),
        (F.col("ground1").isNull(), "outside_dem"), (~F.col("valid1"), "dem_nodata"), (F.col("h1") < F.col("ground1"), "below_terrain"),
        (F.col("first_hit").isNotNull(), "terrain_blocked"), otherwise=F.lit("detectable"),
    )
    return rows.select("target_id", verdict.alias("verdict"))


ASKED = "asked AS (SELECT target_id, (r + target_id % 7 - 3)::INT AS r, (c + target_id % 11 - 5)::INT AS c, z_abs FROM targets)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets moved about, some of them off the grid."""
    k = F.col("target_id")
    return fixtures.targets(spark, sf_dir).select(k, (F.col("r") + k % 7 - 3).cast("int").alias("r"), (F.col("c") + k % 11 - 5).cast("int").alias("c"), "z_abs")


@query(f"{with_('terrain', 'targets')}, {EDGE}, {ASKED} SELECT target_id, r, c, z AS value, CASE WHEN a.r NOT BETWEEN 0 AND max_r OR a.c NOT BETWEEN 0 AND max_c THEN 'outside' WHEN t.r IS NULL OR NOT t.valid THEN 'nodata' ELSE 'ok' END AS state FROM asked a LEFT JOIN terrain t USING (r, c), edge")
def point_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell and value at each point; what is wrong with a point is a column, so the others go on."""
    rows = with_edge(asked(spark, sf_dir), fixtures.terrain(spark, sf_dir)).join(fixtures.terrain(spark, sf_dir), ["r", "c"], "left")
    inside = F.col("r").between(F.lit(0), F.col("max_r")) & F.col("c").between(F.lit(0), F.col("max_c"))
    return rows.select("target_id", "r", "c", F.col("z").alias("value"), case((~inside, "outside"), (~F.coalesce("valid", F.lit(False)), "nodata"), otherwise=F.lit("ok")).alias("state"))


@query(f"{with_('terrain', 'targets')}, {EDGE}, {ASKED}, e AS (SELECT target_id, CASE WHEN r NOT BETWEEN 0 AND max_r OR c NOT BETWEEN 0 AND max_c THEN 'outside' WHEN z_abs < 200 THEN 'too_low' END AS error FROM asked, edge) SELECT coalesce(error, 'none') AS error, count(*) AS targets, min(target_id) AS first_target FROM e GROUP BY 1")
def target_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a batch by their own error; one bad target doesn't fail the rest."""
    rows = with_edge(asked(spark, sf_dir), fixtures.terrain(spark, sf_dir))
    inside = F.col("r").between(F.lit(0), F.col("max_r")) & F.col("c").between(F.lit(0), F.col("max_c"))
    error = case((~inside, "outside"), (F.col("z_abs") < 200, "too_low"), otherwise=F.lit("none"))
    return rows.groupBy(error.alias("error")).agg(F.count("*").alias("targets"), F.min("target_id").alias("first_target"))


CORNERS = "q AS (SELECT target_id, r + 0.3::DOUBLE AS y, c + 0.6::DOUBLE AS x FROM targets), n AS (SELECT target_id, t.z, (t.r - y) * (t.r - y) + (t.c - x) * (t.c - x) AS d2, a * 2 + b AS k FROM q, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b), terrain t WHERE t.r = floor(y)::INT + a AND t.c = floor(x)::INT + b AND t.valid)"


@query(f"{with_('terrain', 'targets')}, {CORNERS} SELECT target_id, arg_min(n.z, (round(d2, 9), k)) AS height, count(n.z) AS corners FROM q LEFT JOIN n USING (target_id) GROUP BY target_id")
def nearest_valid_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height of the nearest valid cell of the four around a point, null where none is valid."""
    y, x = F.col("r") + 0.3, F.col("c") + 0.6
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    points = fixtures.targets(spark, sf_dir).select("target_id", y.alias("y"), x.alias("x"))
    rows = points.withColumn("k", F.explode(corners)).select("target_id", "y", "x", (F.col("k.a") * 2 + F.col("k.b")).alias("k"), (F.floor("y") + F.col("k.a")).cast("int").alias("r"), (F.floor("x") + F.col("k.b")).cast("int").alias("c"))
    rows = rows.join(fixtures.terrain(spark, sf_dir).where("valid"), ["r", "c"], "left")
    d2 = F.round((F.col("r") - F.col("y")) ** 2 + (F.col("c") - F.col("x")) ** 2, 9)
    best = F.min(F.when(F.col("z").isNotNull(), F.struct(d2.alias("d2"), "k", "z")))["z"]
    return rows.groupBy("target_id").agg(best.alias("height"), F.count("z").alias("corners"))


# A mask of one grid (cells of three, shifted by two rows and one column) read at the cells of another.
@query(f"{with_('terrain')}, mask AS (SELECT r AS i, c AS j, valid AND z > 100 AS seen FROM terrain WHERE r % 3 = 0 AND c % 3 = 0) SELECT t.r, t.c, coalesce(m.seen, FALSE) AS seen, m.seen IS NOT NULL AS covered FROM terrain t LEFT JOIN mask m ON m.i = floor((t.r + 0.5 - 2) / 3)::INT * 3 AND m.j = floor((t.c + 0.5 - 1) / 3)::INT * 3 WHERE t.valid")
def realigned_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.terrain(spark, sf_dir)
    mask = cells.where("r % 3 = 0 and c % 3 = 0").select(F.col("r").alias("i"), F.col("c").alias("j"), (F.col("valid") & (F.col("z") > 100)).alias("seen"))
    index = lambda at, shift: (F.floor((F.col(at) + 0.5 - shift) / 3) * 3).cast("int")
    rows = cells.where("valid").select("r", "c", index("r", 2).alias("i"), index("c", 1).alias("j")).join(mask, ["i", "j"], "left")
    return rows.select("r", "c", F.coalesce("seen", F.lit(False)).alias("seen"), F.col("seen").isNotNull().alias("covered"))


@query(f"{with_('terrain')} SELECT (r // 4)::INT AS i, (c // 4)::INT AS j, r * 10.0::DOUBLE + 15 AS y, c * 10.0::DOUBLE + 15 AS x, z FROM terrain WHERE valid AND r % 4 = 0 AND c % 4 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth valid cell of every fourth row, with the centre of the coarser cell."""
    cells = fixtures.terrain(spark, sf_dir).where("valid and r % 4 = 0 and c % 4 = 0")
    return cells.select(F.floor(F.col("r") / 4).cast("int").alias("i"), F.floor(F.col("c") / 4).cast("int").alias("j"), (F.col("r") * 10.0 + 15).alias("y"), (F.col("c") * 10.0 + 15).alias("x"), "z")


@query(f"{with_('terrain')}, s AS (SELECT r, c FROM terrain WHERE valid AND z > 150 AND r % 4 = 0 AND c % 4 = 0), g AS (SELECT DISTINCT s.r + a AS r, s.c + b AS c FROM s, (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE a * a + b * b <= 9) SELECT t.r, count(*) AS cells FROM g JOIN terrain t ON t.r = g.r AND t.c = g.c WHERE t.valid GROUP BY t.r")
def expanded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled mask grown by three quarters of its step and clipped to the valid cells."""
    cells = fixtures.terrain(spark, sf_dir).where("valid")
    disc = shapes.grown(cells.where("z > 150 and r % 4 = 0 and c % 4 = 0").select("r", "c"), 3, [])
    return disc.join(cells.select("r", "c"), ["r", "c"]).groupBy("r").agg(F.count("*").alias("cells"))


@query(f"{with_('terrain', 'stations')}, {WINDOWS}, n AS (SELECT station_id, r0, r1, least(7, r1 - r0 + 1) AS m FROM windows), l AS (SELECT station_id, k, round(r0 + (r1 - r0)::DOUBLE * k / (m - 1), 0)::INT AS r FROM (SELECT *, unnest(range(0, m)) AS k FROM n)) SELECT station_id, k::INT AS k, r FROM l")
def linspace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most seven rows spread evenly over each station's box, first and last among them."""
    w = windows(spark, sf_dir).withColumn("m", F.least(F.lit(7), F.col("r1") - F.col("r0") + 1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return w.select("station_id", "k", F.round(F.col("r0") + (F.col("r1") - F.col("r0")).cast("double") * F.col("k") / (F.col("m") - 1), 0).cast("int").alias("r"))


@query(f"{with_('terrain')}, need AS (SELECT t.r, t.c, count(*) AS n FROM terrain t, (VALUES (0, 0), (0, 3), (2, 0), (-2, -3)) o(a, b), terrain u WHERE u.valid AND u.r = t.r + a AND u.c = t.c + b AND t.valid GROUP BY t.r, t.c) SELECT r, c, n = 4 AS usable, n AS valid_offsets FROM need")
def offset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the number of their required offsets that are valid; a candidate needs all."""
    cells = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c")
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 3), (2, 0), (-2, -3))))
    sent = cells.withColumn("o", F.explode(offsets)).select((F.col("r") - F.col("o.a")).alias("r"), (F.col("c") - F.col("o.b")).alias("c"))
    n = sent.groupBy("r", "c").agg(F.count("*").alias("n"))
    return cells.join(n, ["r", "c"]).select("r", "c", (F.col("n") == 4).alias("usable"), F.col("n").alias("valid_offsets"))


@query(f"{with_('stations')} SELECT station_id, round(79.0 + (c + 0.5) * 0.0002778::DOUBLE, 7) AS lon, round(32.0 - (r + 0.5) * 0.0002778::DOUBLE, 7) AS lat FROM stations")
def cell_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of each station's cell in degrees."""
    return fixtures.stations(spark, sf_dir).select("station_id", F.round(79.0 + (F.col("c") + 0.5) * 0.0002778, 7).alias("lon"), F.round(32.0 - (F.col("r") + 0.5) * 0.0002778, 7).alias("lat"))


@query(f"{with_('stations')}, m AS (SELECT avg(c * 3 - 180)::DOUBLE AS lon, avg(r - 5)::DOUBLE AS lat FROM stations) SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, floor((lon + 180) / 6) + 1)))::INT AS epsg FROM m")
def station_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean place of all stations and the projection it chooses."""
    mean = fixtures.stations(spark, sf_dir).agg(F.avg(F.col("c") * 3 - 180).alias("lon"), F.avg(F.col("r") - 5).alias("lat"))
    return mean.select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


LAYERS = (150.0, 210.0, 270.0, 330.0)


@query(f"{with_('targets')}, l AS (SELECT target_id, z_abs, layer, h FROM targets, (VALUES {', '.join(f'({i}, {h}::DOUBLE)' for i, h in enumerate(LAYERS))}) v(layer, h)) SELECT target_id, arg_min(layer, (abs(z_abs - h), layer))::INT AS layer, min(abs(z_abs - h)) AS off FROM l GROUP BY target_id")
def nearest_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The altitude layer nearest to each target, the lower of two as near."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.col("z_abs") - h).alias("off"), F.lit(i).alias("layer")) for i, h in enumerate(LAYERS))))
    return fixtures.targets(spark, sf_dir).withColumn("best", best).select("target_id", "best.layer", "best.off")


@query("SELECT user_id, list_sort(list(DISTINCT value) FILTER (value BETWEEN 10 AND 60))[1:20]::VARCHAR IS NOT NULL AS any_layer, count(DISTINCT value) FILTER (value BETWEEN 10 AND 60) AS layers, min(value) FILTER (value BETWEEN 10 AND 60) AS lowest, max(value) FILTER (value BETWEEN 10 AND 60) AS highest, coalesce(count(DISTINCT value) FILTER (value BETWEEN 10 AND 60), 0) BETWEEN 1 AND 20 AS accepted FROM events GROUP BY user_id")
def height_layer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height layers asked for by each user: those in range, distinct, and whether there are 1 to 20."""
    v = F.when(F.col("value").between(10, 60), F.col("value"))
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(v).alias("layers"), F.min(v).alias("lowest"), F.max(v).alias("highest"))
    return out.select("user_id", (F.col("layers") > 0).alias("any_layer"), "layers", "lowest", "highest", F.col("layers").between(1, 20).alias("accepted"))


REQUESTS = "SELECT o_orderkey AS task_id, (o_totalprice % 1200)::DOUBLE AS radius, (o_custkey % 400)::INT AS azimuth, (o_orderkey % 13 - 2)::INT AS low, (o_orderkey % 29)::INT AS high FROM orders"


@query(f"WITH q AS ({REQUESTS}), v AS (SELECT task_id, concat_ws(',', CASE WHEN radius < 10 OR radius > 1000 THEN 'radius' END, CASE WHEN azimuth >= 360 THEN 'azimuth' END, CASE WHEN low < -1 THEN 'low' END, CASE WHEN low >= high THEN 'band' END) AS problems FROM q) SELECT problems, count(*) AS requests, min(task_id) AS first_task FROM v GROUP BY problems")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the fields that are out of range or at odds with each other."""
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(k.alias("task_id"), (F.col("o_totalprice") % 1200).cast("double").alias("radius"), (F.col("o_custkey") % 400).alias("azimuth"), (k % 13 - 2).alias("low"), (k % 29).alias("high"))
    wrong = {"radius": (F.col("radius") < 10) | (F.col("radius") > 1000), "azimuth": F.col("azimuth") >= 360, "low": F.col("low") < -1, "band": F.col("low") >= F.col("high")}
    problems = F.concat_ws(",", *(F.when(condition, name) for name, condition in wrong.items()))
    return q.groupBy(problems.alias("problems")).agg(F.count("*").alias("requests"), F.min("task_id").alias("first_task"))


SUMMARY = "done AS (SELECT DISTINCT s_suppkey % 40 AS station_id, 100 + s_nationkey % 7 AS cells FROM supplier WHERE s_suppkey < 40 AND s_suppkey % 3 > 0), failed AS (SELECT s_suppkey AS station_id, 'no data' AS error FROM supplier WHERE s_suppkey % 6 = 0)"


@query(f"{with_('stations')}, {SUMMARY} SELECT station_id, CASE WHEN f.error IS NOT NULL THEN 'failed' WHEN d.cells IS NOT NULL THEN 'finished' ELSE 'pending' END AS status, d.cells::BIGINT AS cells, f.error FROM stations LEFT JOIN done d USING (station_id) LEFT JOIN failed f USING (station_id)")
def station_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested stations with their result or failure; those with neither are pending."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    done = s.where((k < 40) & (k % 3 > 0)).select((k % 40).alias("station_id"), (100 + F.col("s_nationkey") % 7).cast("long").alias("cells")).distinct()
    failed = s.where(k % 6 == 0).select(k.alias("station_id"), F.lit("no data").alias("error"))
    rows = fixtures.stations(spark, sf_dir).select("station_id").join(done, "station_id", "left").join(failed, "station_id", "left")
    status = case((F.col("error").isNotNull(), "failed"), (F.col("cells").isNotNull(), "finished"), otherwise=F.lit("pending"))
    return rows.select("station_id", status.alias("status"), "cells", "error")


@query(f"{with_('terrain', 'zones')} SELECT zone_id, CASE WHEN t.valid THEN t.z END AS ground, t.valid IS NOT NULL AS inside FROM (SELECT zone_id, (r - 2 + zone_id % 3)::INT AS r, c FROM zones) z LEFT JOIN terrain t USING (r, c)")
def zone_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground under each zone's centre, null off the grid and on invalid cells."""
    zones = fixtures.zones(spark, sf_dir).select("zone_id", (F.col("r") - 2 + F.col("zone_id") % 3).cast("int").alias("r"), "c")
    return zones.join(fixtures.terrain(spark, sf_dir), ["r", "c"], "left").select("zone_id", F.when(F.col("valid"), F.col("z")).alias("ground"), F.col("valid").isNotNull().alias("inside"))


@query(f"{with_('terrain', 'targets')} SELECT target_id, CASE target_id % 3 WHEN 0 THEN z_abs WHEN 1 THEN z + 50 ELSE z END AS altitude, CASE target_id % 3 WHEN 0 THEN 'amsl' WHEN 1 THEN 'agl' ELSE 'ground' END AS mode FROM targets LEFT JOIN terrain USING (r, c)")
def terminal_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitude above the sea, from one given so, one above ground, or the ground itself."""
    rows, k = fixtures.targets(spark, sf_dir).join(fixtures.terrain(spark, sf_dir).select("r", "c", "z"), ["r", "c"], "left"), F.col("target_id") % 3
    return rows.select("target_id", case((k == 0, F.col("z_abs")), (k == 1, F.col("z") + 50), otherwise=F.col("z")).alias("altitude"), case((k == 0, "amsl"), (k == 1, "agl"), otherwise=F.lit("ground")).alias("mode"))


FLOATS = "CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'none' WHEN 2 THEN NULL WHEN 3 THEN 'Infinity' ELSE value::VARCHAR END"


@query(f"SELECT event_id, CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END AS number, CASE WHEN x IS NULL THEN 'absent' WHEN try_cast(x AS DOUBLE) IS NULL THEN 'malformed' WHEN NOT isfinite(try_cast(x AS DOUBLE)) THEN 'not_finite' ELSE 'ok' END AS state FROM (SELECT event_id, {FLOATS} AS x FROM events)")
def finite_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from text where they are finite, and what the others are."""
    x = F.expr(FLOATS.replace("value::VARCHAR", "cast(value as string)"))
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("x")).withColumn("n", F.expr("try_cast(x as double)"))
    finite = F.col("n").isNotNull() & ~F.isnan("n") & (F.abs("n") != float("inf"))
    state = case((F.col("x").isNull(), "absent"), (F.col("n").isNull(), "malformed"), (~finite, "not_finite"), otherwise=F.lit("ok"))
    return rows.select("event_id", F.when(finite, F.col("n")).alias("number"), state.alias("state"))


IDS = "CASE o_orderkey % 7 WHEN 0 THEN '../' || o_orderkey WHEN 1 THEN '' WHEN 2 THEN 'a/b' || o_orderkey WHEN 3 THEN repeat('x', 70) ELSE 'task_' || o_orderkey || '-a' END"


@query(f"SELECT o_orderkey AS task_id, id, regexp_full_match(id, '[A-Za-z0-9_-]{{1,64}}') AS accepted FROM (SELECT o_orderkey, {IDS} AS id FROM orders)")
def id_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an id is of 1 to 64 plain characters, so that no path can be made of it."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.expr(IDS).alias("id")).withColumn("accepted", F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$"))


@query(f"{with_('routes')} SELECT route_id, seq, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || x::INT || ',' || y::INT || ']}},\"properties\":{{\"route_id\":' || route_id || ',\"seq\":' || seq || '}}}}' AS feature FROM routes")
def sample_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waypoints as point features."""
    feature = geojson.point_feature(F.col("x").cast("int"), F.col("y").cast("int"), F.struct("route_id", "seq"))
    return fixtures.routes(spark, sf_dir).select("route_id", "seq", feature.alias("feature"))


# What each kind of output is.
OUTPUTS = ((1, "visible cells"), (2, "blocked cells"), (3, "metrics"), (4, "voxels"), (5, "profile"), (6, "log"))


@query(f"SELECT l_orderkey AS task_id, l_linenumber::INT AS kind, coalesce(any_value(name), 'other output') AS description, count(*) AS files FROM lineitem LEFT JOIN (VALUES {', '.join(f'({k}, {n!r})' for k, n in OUTPUTS)}) v(kind, name) ON l_linenumber = kind GROUP BY ALL")
def output_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in OUTPUTS for x in kv))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("int").alias("kind")).agg(F.count("*").alias("files"))
    return rows.select("task_id", "kind", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("other output")).alias("description"), "files")


@query("SELECT l_orderkey % 100 AS station_id, o_orderkey AS task_id, min(l_linenumber)::INT AS asset FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber IN (2, 4) GROUP BY ALL")
def scene_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scene file of each station's finished tasks that have one."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task_id"))
    files = table(spark, sf_dir, "lineitem").where("l_linenumber in (2, 4)").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.min("l_linenumber").cast("int").alias("asset"))
    return done.join(files, "task_id").select((F.col("task_id") % 100).alias("station_id"), "task_id", "asset")


@query(f"SELECT station_id, count(*) AS points, count(DISTINCT (r, c)) AS columns_, max(z_agl) AS highest, round(max(clearance), 6) AS most_clearance FROM ({visibility.REGISTRY.oracle['voxel_points']}) GROUP BY station_id")
def voxel_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and maxima of each station's voxel points; its columns are the bits set in words of blocks, so no column is a row."""
    points = visibility.voxel_points(spark, sf_dir)
    words = bitmaps.packed(points, ["station_id"], {"word": F.lit(True)}, {"points": F.count("*"), "highest": F.max("z_agl"), "most": F.max("clearance")})
    columns = F.sum(F.bit_count("word").cast("long"))
    return words.groupBy("station_id").agg(F.sum("points").alias("points"), columns.alias("columns_"), F.max("highest").alias("highest"), F.round(F.max("most"), 6).alias("most_clearance"))


@query(f"{with_('terrain', 'zones')}, z AS (SELECT r, c, r_inner FROM zones), hit AS (SELECT DISTINCT t.r, t.c FROM terrain t JOIN z ON (t.r - z.r) * (t.r - z.r) + (t.c - z.c) * (t.c - z.c) <= (z.r_inner + 1) * (z.r_inner + 1)) SELECT r, count(*) AS cells FROM hit GROUP BY r")
def buffered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within a buffer around any zone, each counted once."""
    zones = fixtures.zones(spark, sf_dir).select("r", "c", (F.col("r_inner") + 1).alias("range_cells")).distinct()
    return visibility.masks.around(fixtures.terrain(spark, sf_dir).select("r", "c"), zones).select("r", "c").distinct().groupBy("r").agg(F.count("*").alias("cells"))


@query(f"{with_('terrain')}, {EDGE}, k AS (SELECT greatest(1, ceil((max_r + 1) / 48.0::DOUBLE))::INT AS kr, greatest(1, ceil((max_c + 1) / 48.0::DOUBLE))::INT AS kc FROM edge) SELECT (r // kr)::INT AS i, (c // kc)::INT AS j, z, kr * 10.0::DOUBLE AS step_y, kc * 10.0::DOUBLE AS step_x FROM terrain, k WHERE r % kr = 0 AND c % kc = 0 AND valid")
def decimated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid thinned to at most 48 cells a side."""
    cells = fixtures.terrain(spark, sf_dir)
    rows = with_edge(cells, cells).withColumns({"kr": F.greatest(F.lit(1), F.ceil((F.col("max_r") + 1) / 48)).cast("int"), "kc": F.greatest(F.lit(1), F.ceil((F.col("max_c") + 1) / 48)).cast("int")})
    rows = rows.where("valid and r % kr = 0 and c % kc = 0")
    return rows.select(F.floor(F.col("r") / F.col("kr")).cast("int").alias("i"), F.floor(F.col("c") / F.col("kc")).cast("int").alias("j"), "z", (F.col("kr") * 10.0).alias("step_y"), (F.col("kc") * 10.0).alias("step_x"))


ACTIVE = "(o_orderstatus = 'O')"


@query(f"SELECT o_orderkey AS task_id, CASE WHEN {ACTIVE} THEN 'refused' WHEN files IS NULL THEN 'nothing' ELSE 'deleted' END AS outcome, CASE WHEN {ACTIVE} THEN 0 ELSE coalesce(files, 0) END AS files FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS files FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting each task would do: refused while it is active, else its files."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"))
    active = F.col("o_orderstatus") == "O"
    rows = table(spark, sf_dir, "orders").join(files, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("task_id"), case((active, "refused"), (F.col("files").isNull(), "nothing"), otherwise=F.lit("deleted")).alias("outcome"), F.when(active, F.lit(0)).otherwise(F.coalesce("files", F.lit(0))).alias("files"))


@query("SELECT o_orderkey AS task_id, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN 'dem_' || o_custkey % 50 END, 'dem_' || o_custkey % 9) AS dem_id, o_orderkey % 4 = 0 AS upgraded, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS version FROM orders")
def legacy_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a dem take it from their request, and are marked."""
    old = F.col("o_orderkey") % 4 == 0
    own = F.when(~old, F.concat(F.lit("dem_"), F.col("o_custkey") % 50))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.coalesce(own, F.concat(F.lit("dem_"), F.col("o_custkey") % 9)).alias("dem_id"), old.alias("upgraded"), F.when(old, 1).otherwise(2).alias("version"))


@query("WITH m AS (SELECT l_orderkey AS task_id, l_linenumber AS kind, sum(l_quantity) AS size, sum(l_quantity) + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS stored, l_orderkey % 5 = 0 AND l_linenumber = 2 AS gone FROM lineitem GROUP BY l_orderkey, l_linenumber), s AS (SELECT task_id, CASE WHEN gone THEN 'missing' WHEN size <> stored THEN 'changed' ELSE 'ok' END AS state FROM m) SELECT state, count(*) AS files, count(DISTINCT task_id) AS tasks FROM s GROUP BY state")
def reconcile_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries held against what is stored, by what a repair would find; nothing is changed."""
    k = F.col("l_orderkey")
    m = table(spark, sf_dir, "lineitem").groupBy(k, "l_linenumber").agg(F.sum("l_quantity").alias("size"))
    m = m.withColumn("stored", F.col("size") + F.when(k % 11 == 0, F.lit(1)).otherwise(F.lit(0)))
    state = case(((k % 5 == 0) & (F.col("l_linenumber") == 2), "missing"), (F.col("size") != F.col("stored"), "changed"), otherwise=F.lit("ok"))
    return m.groupBy(state.alias("state")).agg(F.count("*").alias("files"), F.countDistinct("l_orderkey").alias("tasks"))
