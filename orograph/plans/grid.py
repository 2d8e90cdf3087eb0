"""Queries on regions, surfaces, overviews, tiles, projections and resampling, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import regions
from orograph.operators.registry import Registry
from orograph.sources import fixtures
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

CELLS = "cells AS (SELECT r, c, floor(z / 60)::INT AS value FROM terrain WHERE valid)"
RUNS = CELLS + ", runs AS (SELECT value, r, b, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY value, r ORDER BY c) AS island, c // 256 AS b FROM cells) GROUP BY value, r, b, island)"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, value): elevation classes of 60."""
    return fixtures.terrain(spark, sf_dir).where("valid").select("r", "c", F.floor(F.col("z") / 60).cast("int").alias("value"))


@query(f"{with_('terrain')}, {RUNS} SELECT value, r, c0, c1 FROM runs")
def cell_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.runs(classes(spark, sf_dir))


@query(f"""{with_('terrain')}, {RUNS}, ids AS MATERIALIZED (SELECT *, r::BIGINT * 2147483648 + c0 AS id FROM runs), links AS MATERIALIZED (SELECT a.id, b.id AS other FROM ids a JOIN ids b ON a.value = b.value AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
    reach(id, region) USING KEY (id) AS (SELECT id, id FROM ids UNION (SELECT l.other, min(x.region) FROM reach x JOIN links l ON l.id = x.id JOIN recurring.reach o ON o.id = l.other WHERE x.region < o.region GROUP BY l.other))
    SELECT value, region, sum(c1 - c0 + 1)::BIGINT AS cells, count(*) AS runs FROM ids JOIN reach USING (id) GROUP BY value, region""")
def count_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = regions.components(regions.runs(classes(spark, sf_dir)))
    return parts.groupBy("value", "region").agg(F.sum((F.col("c1") - F.col("c0") + 1).cast("long")).alias("cells"), F.count("*").alias("runs"))


@query(f"{with_('terrain')}, {CELLS}, e AS (SELECT value, 'h' AS kind, r, c FROM cells UNION ALL SELECT value, 'h', r + 1, c FROM cells UNION ALL SELECT value, 'v', r, c FROM cells UNION ALL SELECT value, 'v', r, c + 1 FROM cells), o AS (SELECT value, kind, r, c FROM e GROUP BY ALL HAVING count(*) = 1) SELECT value, kind, count(*) AS edges FROM o GROUP BY ALL")
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.edges(classes(spark, sf_dir)).groupBy("value", "kind").agg(F.count("*").alias("edges"))


@query(f"""{with_('terrain')}, vox AS MATERIALIZED (SELECT r, c, k FROM terrain, (SELECT unnest(range(0, 12)) AS k) WHERE valid AND k * 20 <= z),
    ways AS (SELECT * FROM (VALUES (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) v(a, b, e))
    SELECT k::INT AS k, count(*) AS faces FROM (SELECT v.k FROM vox v, ways WHERE NOT EXISTS (SELECT 1 FROM vox o WHERE o.r = v.r + a AND o.c = v.c + b AND o.k = v.k + e)) GROUP BY k""")
def exposed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = fixtures.terrain(spark, sf_dir).where("valid").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).where("k * 20 <= z").select("r", "c", "k")
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(e).alias("e")) for a, b, e in ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))))
    faces = voxels.withColumn("w", F.explode(ways)).select("k", (F.col("r") + F.col("w.a")).alias("fr"), (F.col("c") + F.col("w.b")).alias("fc"), (F.col("k") + F.col("w.e")).alias("fk"))
    taken = voxels.select(F.col("r").alias("fr"), F.col("c").alias("fc"), F.col("k").alias("fk"))
    return faces.join(taken, ["fr", "fc", "fk"], "left_anti").groupBy("k").agg(F.count("*").alias("faces"))


@query(f"{with_('terrain')} SELECT (r // 8)::INT AS tr, (c // 8)::INT AS tc, count(*) FILTER (valid) AS cells, round(avg(z) FILTER (valid), 6) AS mean_z, min(z) FILTER (valid) AS min_z, max(z) FILTER (valid) AS max_z FROM terrain GROUP BY ALL")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("valid"), F.col("z"))
    cells = fixtures.terrain(spark, sf_dir).groupBy(F.floor(F.col("r") / 8).cast("int").alias("tr"), F.floor(F.col("c") / 8).cast("int").alias("tc"))
    return cells.agg(F.count(z).alias("cells"), F.round(F.avg(z), 6).alias("mean_z"), F.min(z).alias("min_z"), F.max(z).alias("max_z"))


@query(f"{with_('terrain')} SELECT r, c, z FROM terrain WHERE valid AND r BETWEEN 2 AND 9 AND c BETWEEN 30 AND 60")
def window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.terrain(spark, sf_dir).where("valid and r between 2 and 9 and c between 30 and 60").select("r", "c", "z")


@query(f"""{with_('terrain')}, grid AS (SELECT i, j, 1.5::DOUBLE * i + 0.25 AS y, 1.5::DOUBLE * j + 0.25 AS x FROM (SELECT unnest(range(0, floor((SELECT max(r) FROM terrain) / 1.5)::BIGINT + 1)) AS i), (SELECT unnest(range(0, floor((SELECT max(c) FROM terrain) / 1.5)::BIGINT + 1)) AS j)),
    w AS (SELECT i, j, sum(wt) FILTER (valid) AS weight, sum(wt * z) FILTER (valid) AS total FROM (SELECT i, j, a, b, (CASE WHEN a = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN b = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS wt, floor(y)::INT + a AS r, floor(x)::INT + b AS c FROM grid, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b)) q JOIN terrain USING (r, c) GROUP BY i, j)
    SELECT i::INT AS i, j::INT AS j, round(total / weight, 6) AS z FROM w WHERE weight > 1e-6""")
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda a: F.lit(1.5) * F.col(a) + 0.25
    rows = fixtures.terrain(spark, sf_dir).agg(F.floor(F.max("r") / 1.5).cast("int").alias("last"), F.floor(F.max("c") / 1.5).cast("int").alias("right"))  # one row
    grid = rows.select(F.explode(F.sequence(F.lit(0), "last")).alias("i"), "right").repartition("i")
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("right")))).withColumns({"y": place("i"), "x": place("j")})
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    part = lambda v, side: F.when(F.col(side) == 0, 1 - (F.col(v) - F.floor(v))).otherwise(F.col(v) - F.floor(v))
    rows = grid.withColumn("k", F.explode(corners)).select("i", "j", "x", "y", "k.a", "k.b")
    rows = rows.withColumns({"w": part("y", "a") * part("x", "b"), "r": (F.floor("y") + F.col("a")).cast("int"), "c": (F.floor("x") + F.col("b")).cast("int")})
    out = rows.join(fixtures.terrain(spark, sf_dir).where("valid").hint("merge"), ["r", "c"]).groupBy("i", "j").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("z")).alias("total"))
    return out.where("weight > 1e-6").select("i", "j", F.round(F.col("total") / F.col("weight"), 6).alias("z"))


@query(f"""{with_('terrain')}, holes AS (SELECT r, c FROM terrain WHERE NOT valid), near AS (SELECT h.r, h.c, sum(t.z / d2) / sum(1.0::DOUBLE / d2) AS z FROM (SELECT h.r, h.c, t.z, ((t.r - h.r) * (t.r - h.r) + (t.c - h.c) * (t.c - h.c))::DOUBLE AS d2 FROM holes h JOIN terrain t ON t.valid AND t.r BETWEEN h.r - 2 AND h.r + 2 AND t.c BETWEEN h.c - 2 AND h.c + 2) t, (SELECT 1) o, LATERAL (SELECT t.r, t.c) h GROUP BY h.r, h.c)
    SELECT h.r, h.c, round(n.z, 6) AS z FROM holes h LEFT JOIN near n ON n.r = h.r AND n.c = h.c""")
def fill_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.terrain(spark, sf_dir)
    steps = F.sequence(F.lit(-2), F.lit(2))
    holes = cells.where("not valid").select(F.col("r").alias("hr"), F.col("c").alias("hc")).withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).where("a <> 0 or b <> 0")
    holes = holes.withColumns({"r": F.col("hr") + F.col("a"), "c": F.col("hc") + F.col("b"), "d2": (F.col("a") * F.col("a") + F.col("b") * F.col("b")).cast("double")})
    out = holes.join(cells.where("valid"), ["r", "c"], "left").groupBy("hr", "hc").agg((F.sum(F.col("z") / F.col("d2")) / F.sum(F.when(F.col("z").isNotNull(), 1 / F.col("d2")))).alias("z"))
    return out.select(F.col("hr").alias("r"), F.col("hc").alias("c"), F.round("z", 6).alias("z"))


@query(f"{with_('terrain')}, s AS (SELECT r // 16 AS tr, c // 16 AS tc, count(*) AS n, sum(r % 16) AS sx, sum(c % 16) AS sy, sum((r % 16) * (r % 16)) AS sxx, sum((c % 16) * (c % 16)) AS syy, sum((r % 16) * (c % 16)) AS sxy, sum(z) AS sz, sum((r % 16) * z) AS sxz, sum((c % 16) * z) AS syz FROM terrain WHERE valid GROUP BY ALL), d AS (SELECT *, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy, sxz - sx * sz / n AS xz, syz - sy * sz / n AS yz FROM s) SELECT tr::INT AS tr, tc::INT AS tc, n AS cells, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 4) AS slope_r, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 4) AS slope_c FROM d WHERE xx * yy - xy * xy > 0.5")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("r") % 16, F.col("c") % 16, F.col("z")
    keys = [F.floor(F.col("r") / 16).cast("int").alias("tr"), F.floor(F.col("c") / 16).cast("int").alias("tc")]
    s = fixtures.terrain(spark, sf_dir).where("valid").groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sz": z, "sxz": x * z, "syz": y * z}.items())
    )
    about = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    d = s.withColumns({"xx": about("sxx", "sx", "sx"), "yy": about("syy", "sy", "sy"), "xy": about("sxy", "sx", "sy"), "xz": about("sxz", "sx", "sz"), "yz": about("syz", "sy", "sz")})
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    slope = lambda a, b, c: F.round((F.col(a) * F.col(b) - F.col(c) * F.col("xy")) / det, 4)
    return d.where(det > 0.5).select("tr", "tc", F.col("n").alias("cells"), slope("xz", "yy", "yz").alias("slope_r"), slope("yz", "xx", "xz").alias("slope_c"))


@query(f"{with_('terrain')} SELECT round(quantile_cont(z, 0.02), 6) AS low, round(quantile_cont(z, 0.98), 6) AS high FROM terrain WHERE valid")
def color_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = quantiles(fixtures.terrain(spark, sf_dir).where("valid").select(F.col("z").alias("v")), (0.02, 0.98))
    return low.select(F.round("q", 6).alias("low")).join(F.broadcast(high.select(F.round("q", 6).alias("high"))))


def quantiles(values: DataFrame, shares: tuple[float, ...]) -> list[DataFrame]:
    """One row ``q`` for each share: the exact quantile of ``v``, interpolated between neighbours.

    Whole numbers below the values are the buckets: their counts say in which ones
    the wanted ranks lie, and only those are ranked, by counts of equal values.
    """
    counts = values.groupBy("v").agg(F.count("*").alias("n")).withColumn("b", F.floor("v"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each metre that occurs.
    buckets = counts.groupBy("b").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    total = F.broadcast(values.agg(F.count("*").alias("total")))
    out = []
    for share in shares:
        at = F.lit(share) * (F.col("total") - 1)
        wanted = buckets.join(total).where((F.col("before") <= F.ceil(at)) & (F.col("before") + F.col("n") > F.floor(at))).select("b", "before", at.alias("at"))
        inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.join(F.broadcast(wanted), "b").withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("v")))
        ends = ranked.agg(holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"), F.max("at").alias("at"))
        out.append(ends.select((F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("q")))
    return out


@query(f"{with_('terrain')} SELECT r, c, floor((z + 32768) / 256)::INT AS red, floor((z + 32768) % 256)::INT AS green, floor((z + 32768 - floor(z + 32768)) * 256)::INT AS blue FROM terrain WHERE valid")
def terrarium_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.terrain(spark, sf_dir).where("valid").select("r", "c", *S.terrarium(F.col("z")))


RAMP = [(0.0, (35, 94, 49)), (0.35, (155, 180, 96)), (0.7, (150, 111, 64)), (1.0, (245, 245, 240))]


def _ramp(channel: int) -> str:
    out = f"{RAMP[-1][1][channel]}"
    for (a, p), (b, q) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
        out = f"CASE WHEN v < {b} THEN {p[channel]} + (v - {a}) * {q[channel] - p[channel]} / {round(b - a, 6)} ELSE {out} END"
    return f"CAST(floor({out}) AS INT)"


@query(f"{with_('terrain')}, n AS (SELECT r, c, greatest(0.0, least(1.0, z / 222)) AS v FROM terrain WHERE valid) SELECT r, c, {_ramp(0)} AS red, {_ramp(1)} AS green, {_ramp(2)} AS blue FROM n")
def color_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("z") / 222)).alias("v"))
    return n.select("r", "c", *(F.expr(_ramp(k)).alias(name) for k, name in enumerate(("red", "green", "blue"))))


@query(f"""{with_('targets')}, t AS (SELECT target_id, (8 + target_id % 5)::DOUBLE AS zoom, (target_id * 7 % 200)::DOUBLE AS x, (target_id * 3 % 150)::DOUBLE AS y FROM targets)
    SELECT target_id, round(x / pow(2, zoom) * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, zoom))))), 6) AS south, round((x + 1) / pow(2, zoom) * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, zoom))))), 6) AS north FROM t""")
def slippy_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("target_id")
    bounds = S.tile_bounds((8 + k % 5).cast("double"), (k * 7 % 200).cast("double"), (k * 3 % 150).cast("double"))
    return fixtures.targets(spark, sf_dir).select(k, *(F.round(b, 6).alias(n) for b, n in zip(bounds, ("west", "south", "east", "north"), strict=True)))


PLACES = "places AS (SELECT target_id, (target_id * 13 % 3590 - 1795) / 10.0::DOUBLE AS lon, (target_id * 7 % 1600 - 800) / 10.0::DOUBLE AS lat FROM targets)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("target_id")
    return fixtures.targets(spark, sf_dir).select(k, ((k * 13 % 3590 - 1795) / 10.0).alias("lon"), ((k * 7 % 1600 - 800) / 10.0).alias("lat"))


@query(f"{with_('targets')}, {PLACES} SELECT target_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, floor((lon + 180) / 6) + 1)))::INT AS epsg FROM places")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("target_id", S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"""{with_('targets')}, {PLACES}, k AS (SELECT target_id, lat < 0 AS south, radians(lat) AS phi, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS lam, (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n FROM places),
    t AS (SELECT *, sinh(atanh(sin(phi)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(phi))) AS t FROM k), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3, 0.9996 * 6378137.0 / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS s FROM t)
    SELECT target_id, round(500000 + s * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting, round(s * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN south THEN 10000000 ELSE 0 END, 3) AS northing FROM x""")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    central = F.floor((F.col("lon") + 180) / 6) * 6 - 177
    east, north = S.utm(F.col("lon"), F.col("lat"), central, F.col("lat") < 0)
    return places(spark, sf_dir).select("target_id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query(f"{with_('targets')}, {PLACES} SELECT a.target_id, round((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360, 6) AS bearing FROM places a JOIN places b ON b.target_id = a.target_id + 1")
def sphere_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = places(spark, sf_dir)
    b = a.select((F.col("target_id") - 1).alias("target_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    return a.join(b, "target_id").select("target_id", F.round(S.bearing(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1")), 6).alias("bearing"))


@query("""SELECT p_partkey AS part_id, round(CASE WHEN p_size % 10 > 0 THEN pow((1000.0::DOUBLE * (p_size % 10)) * pow(10, 3.0) * pow(10, 3.0) * pow(299792458.0 / (1e9 * (1 + p_partkey % 9)), 2) * 2.0 / (pow(4 * pi(), 3) * pow(10, (-100 - 30) / 10.0) * pow(10, 0.3)), 0.25) END, 3) AS range_m FROM part""")
def radar_equation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    power, frequency = F.lit(1000.0) * (F.col("p_size") % 10), F.lit(1e9) * (1 + F.col("p_partkey") % 9)
    reach = S.radar_equation_range(power, frequency, F.lit(30.0), F.lit(-100.0), F.lit(2.0), F.lit(3.0))
    return fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.round(reach, 3).alias("range_m"))


@query(f"{with_('targets', 'stations')} SELECT target_id, round(0.25 * 500 * (abs(c - 60) * 100 + 500 - 500) / (2 * 6371000.0), 9) AS bulge, round(sqrt(2 * (6371000.0 / 0.25) * z_abs), 3) AS horizon FROM targets")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.abs(F.col("c") - 60) * 100 + 500
    return fixtures.targets(spark, sf_dir).select("target_id", F.round(S.bulge(total, F.lit(500), 0.25), 9).alias("bulge"), F.round(S.horizon(F.col("z_abs"), 0.25), 3).alias("horizon"))


@query(f"{with_('stations', 'terrain')}, b AS (SELECT floor(min(g.z) / 100) * 100 AS base, (min(s.c) + max(s.c)) * 5.0::DOUBLE AS cx, (min(s.r) + max(s.r)) * 5.0::DOUBLE AS cy FROM stations s JOIN terrain g USING (r, c)) SELECT station_id, s.c * 10 - cx AS x, z - base AS y, s.r * 10 - cy AS south FROM stations s JOIN terrain g USING (r, c), b")
def scene_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.stations(spark, sf_dir).join(fixtures.terrain(spark, sf_dir), ["r", "c"])
    box = rows.agg(
        (F.floor(F.min("z") / 100) * 100).alias("base"), ((F.min("c") + F.max("c")) * 5.0).alias("cx"), ((F.min("r") + F.max("r")) * 5.0).alias("cy")
    )  # one row
    return rows.join(F.broadcast(box)).select("station_id", (F.col("c") * 10 - F.col("cx")).alias("x"), (F.col("z") - F.col("base")).alias("y"), (F.col("r") * 10 - F.col("cy")).alias("south"))
