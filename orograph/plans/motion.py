"""Queries on routes, footprints, slopes, speeds, penalty zones and least-cost paths, with their oracle SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import paths
from orograph.operators.checkpoint import durable
from orograph.operators.registry import Registry
from orograph.sources import fixtures
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

LEGS = "legs AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(heading) OVER w AS heading2 FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq))"


def legs(routes: DataFrame) -> DataFrame:
    """Waypoints with the next waypoint of their route."""
    w = Window.partitionBy("route_id").orderBy("seq")
    return routes.withColumns({n + "2": F.lead(n).over(w) for n in ("x", "y", "heading")})


def length() -> Column:
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return F.sqrt(dx * dx + dy * dy)


LENGTH = "sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))"


@query(f"{with_('routes')}, {LEGS} SELECT route_id, count(*) AS waypoints, round(coalesce(sum({LENGTH}), 0), 4) AS length FROM legs GROUP BY route_id")
def route_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(fixtures.routes(spark, sf_dir)).groupBy("route_id").agg(F.count("*").alias("waypoints"), F.round(F.coalesce(F.sum(length()), F.lit(0.0)), 4).alias("length"))


RESAMPLED = f"""steps AS (SELECT *, greatest(1, ceil({LENGTH} / 20.0))::BIGINT AS n FROM legs WHERE x2 IS NOT NULL),
points AS (SELECT route_id, seq, k, x + (x2 - x) * k / n AS px, y + (y2 - y) * k / n AS py, (heading + (((heading2 - heading + 540) % 360) - 180) * (k::DOUBLE / n) + 360) % 360 AS ph FROM (SELECT *, unnest(range(0, n)) AS k FROM steps)
    UNION ALL SELECT route_id, seq, 0, x, y, heading FROM legs WHERE x2 IS NULL)"""


#: Points that one task makes of its legs, about.
TASK_POINTS = 4_000_000


def resampled(routes: DataFrame, interval: float = 20.0) -> DataFrame:
    """Points every ``interval`` along each leg, and each route's last waypoint.

    Legs are few and points many, so legs are dealt to tasks by the number of
    their points, in the order of their ends: points of equal legs follow each
    other, and files say them once.
    """
    steps = F.when(F.col("x2").isNotNull(), F.greatest(F.lit(1), F.ceil(length() / interval))).cast("long")
    rows = durable(legs(routes).withColumn("n", steps))
    steps = rows.where("x2 is not null")
    tasks = (steps.agg(F.sum("n")).first()[0] or 0) // TASK_POINTS + 1
    order = ["x", "x2", "heading", "heading2", "y", "y2", "route_id", "seq"]
    steps = steps.repartitionByRange(tasks, *order).sortWithinPartitions("n", *order)
    steps = steps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda a: F.col(a) + (F.col(a + "2") - F.col(a)) * F.col("k") / F.col("n")
    heading = S.between_angles(F.col("heading"), F.col("heading2"), F.col("k") / F.col("n"))
    points = steps.select("route_id", "seq", "k", at("x").alias("px"), at("y").alias("py"), heading.alias("ph"))
    return points.unionByName(rows.where("x2 is null").select("route_id", "seq", F.lit(0).cast("long").alias("k"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("heading").alias("ph")))


@query(f"{with_('routes')}, {LEGS}, {RESAMPLED} SELECT route_id, seq, k, round(px, 6) AS px, round(py, 6) AS py, round(ph, 6) AS heading FROM points")
def route_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6  # noqa: E731  (a step of F.round goes through a decimal number)
    return resampled(fixtures.routes(spark, sf_dir)).select("route_id", "seq", "k", near("px").alias("px"), near("py").alias("py"), near("ph").alias("heading"))


@query(f"{with_('routes')}, {LEGS}, h AS (SELECT route_id, seq, CASE WHEN x2 IS NOT NULL THEN (degrees(atan2(x2 - x, y2 - y)) + 360) % 360 END AS b FROM legs) SELECT route_id, seq, round(coalesce(b, lag(b) OVER (PARTITION BY route_id ORDER BY seq)), 6) AS bearing FROM h")
def route_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs(fixtures.routes(spark, sf_dir)).withColumn("b", S.azimuth(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    w = Window.partitionBy("route_id").orderBy("seq")
    return rows.select("route_id", "seq", F.round(F.coalesce("b", F.lag("b").over(w)), 6).alias("bearing"))


@query(f"{with_('routes')}, {LEGS}, a AS (SELECT *, floor(x / 30)::INT AS layer, floor(x2 / 30)::INT AS layer2 FROM legs) SELECT route_id, count(*) FILTER (layer <> layer2) AS changes FROM a GROUP BY route_id")
def altitude_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda a: F.floor(F.col(a) / 30)
    return legs(fixtures.routes(spark, sf_dir)).groupBy("route_id").agg(F.count_if(layer("x") != layer("x2")).alias("changes"))


# Sensor footprints of the waypoints: at 400, 40 to 300 away in the slant (so up to 30 cells), 90 degrees wide, looking 20 to 80 degrees down.
FOOT = """w AS (SELECT route_id, seq, x::INT AS px, y::INT AS py, heading FROM routes),
o AS (SELECT a, b, sqrt((a * a + b * b)::DOUBLE) * 10 AS away, (degrees(atan2(b::DOUBLE, -a::DOUBLE)) + 360) % 360 AS az FROM (SELECT unnest(range(-30, 31)) AS a), (SELECT unnest(range(-30, 31)) AS b) WHERE a * a + b * b BETWEEN 16 AND 900),
s AS (SELECT route_id, seq, py + a AS r, px + b AS c, away FROM w JOIN o ON abs((az - heading + 180 + 360) % 360 - 180) <= 45),
foot AS (SELECT route_id, seq, r, c FROM s JOIN terrain USING (r, c) WHERE valid AND sqrt(away * away + (z - 400) * (z - 400)) <= 300 AND degrees(atan2(400 - z, away)) BETWEEN 20 AND 80)"""


def offsets(spark: SparkSession) -> list:
    """The cells (a, b) 4 to 30 away from a waypoint with their distance and azimuth: some 2,700 rows, whatever the data."""
    place = spark.range(61 * 61).select((F.floor(F.col("id") / 61) - 30).cast("int").alias("a"), (F.col("id") % 61 - 30).cast("int").alias("b"))
    d2 = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    azimuth = S.azimuth(F.col("b").cast("double"), -F.col("a").cast("double"))
    return place.where(d2.between(16, 900)).select("a", "b", (F.sqrt(d2.cast("double")) * 10).alias("away"), azimuth.alias("az")).collect()


def footprints(spark: SparkSession, sf_dir: str, union: bool, side: int = 128, most: int = 4096) -> DataFrame:
    """How many cells a sensor sees in each tile: from each waypoint (route_id, seq, cells), or with ``union`` of each route (route_id, union_cells, sum_cells).

    Waypoints are sent to the tiles that their reach touches and meet the
    terrain there; a cell is of one tile, so what tiles count adds up. A task has
    at most about ``most`` waypoints over one tile, and all of a route.
    """
    fixed = np.array([tuple(x) for x in offsets(spark)])
    da, db, away, az = fixed[:, 0].astype(np.int64), fixed[:, 1].astype(np.int64), fixed[:, 2], fixed[:, 3]
    points = fixtures.routes(spark, sf_dir).select("route_id", "seq", F.col("y").cast("int").alias("py"), F.col("x").cast("int").alias("px"), "heading")
    touched = lambda n: F.explode(F.sequence(F.floor((F.col(n) - 30) / side), F.floor((F.col(n) + 30) / side)))
    points = points.withColumn("tr", touched("py")).withColumn("tc", touched("px"))
    terrain = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c", "z", F.floor(F.col("r") / side).alias("tr"), F.floor(F.col("c") / side).alias("tc"))
    parts = points.groupBy("tr", "tc").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))  # one row a tile
    points = points.join(F.broadcast(parts), ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64("route_id"), "parts").cast("int")).drop("parts")
    terrain = terrain.join(F.broadcast(parts), ["tr", "tc"]).select(F.col("tr").alias("to_tr"), F.col("tc").alias("to_tc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"), "r", "c", "z")
    names = ["route_id", "union_cells", "sum_cells"] if union else ["route_id", "seq", "cells"]

    def look(key, some: pa.Table, ground: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and ground.num_rows:
            top, left, wide = key[0].as_py() * side - 60, key[1].as_py() * side - 60, side + 120
            z = np.full(wide * wide, np.nan)  # with a margin as wide as the way there and back
            z[(ground["r"].to_numpy().astype(np.int64) - top) * wide + ground["c"].to_numpy() - left] = ground["z"].to_numpy()
            by_heading, whose = {}, {}
            for route, seq, py, px, heading in zip(*(some[n].to_pylist() for n in ("route_id", "seq", "py", "px", "heading")), strict=True):
                if heading not in by_heading:
                    ahead = np.abs(np.fmod(az - heading + 180 + 360, 360) - 180) <= 45
                    by_heading[heading] = (da[ahead] * wide + db[ahead], away[ahead])
                step, far = by_heading[heading]
                at = (py - top) * wide + px - left + step
                high = z[at]
                down = np.degrees(np.arctan2(400 - high, far))
                seen = (np.sqrt(far * far + (high - 400) * (high - 400)) <= 300) & (down >= 20) & (down <= 80)  # not where there is no ground
                if union:
                    whose.setdefault(route, []).append(at[seen])
                elif seen.any():
                    out.append((route, seq, int(seen.sum())))
            for route, cells in whose.items():
                total = sum(map(len, cells))
                if total:
                    out.append((route, len(np.unique(np.concatenate(cells))) if len(cells) > 1 else total, total))
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    found = points.groupBy("tr", "tc", "part").cogroup(terrain.groupBy("to_tr", "to_tc", "to_part")).applyInArrow(look, schema)
    keys = [n for n in names if not n.endswith("cells")]
    return found.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names if n not in keys))


@query(f"{with_('terrain', 'routes')}, {FOOT} SELECT route_id, seq, count(*) AS cells FROM foot GROUP BY ALL")
def sensor_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints(spark, sf_dir, False).withColumn("seq", F.col("seq").cast("int"))


@query(f"{with_('terrain', 'routes')}, {FOOT}, u AS (SELECT route_id, count(*) AS union_cells, sum(n)::BIGINT AS sum_cells FROM (SELECT route_id, r, c, count(*) AS n FROM foot GROUP BY ALL) GROUP BY route_id) SELECT *, sum_cells - union_cells AS overlap_cells FROM u")
def route_coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = footprints(spark, sf_dir, True)
    return out.withColumn("overlap_cells", F.col("sum_cells") - F.col("union_cells"))


# Slope: central differences, one-sided at the edges, of cells of 10 metres; invalid cells are filled by the mean and get 90 degrees.
SLOPE = """filled AS (SELECT r, c, valid, CASE WHEN valid THEN z ELSE (SELECT avg(z) FROM terrain WHERE valid) END AS z FROM terrain),
grad AS (SELECT *, lag(z) OVER wr AS zr0, lead(z) OVER wr AS zr1, lag(z) OVER wc AS zc0, lead(z) OVER wc AS zc1 FROM filled WINDOW wr AS (PARTITION BY c ORDER BY r), wc AS (PARTITION BY r ORDER BY c)),
slope AS (SELECT r, c, valid, CASE WHEN valid THEN degrees(atan(sqrt(gr * gr + gc * gc))) ELSE 90.0 END AS slope FROM (SELECT *,
    (coalesce(zr1, z) - coalesce(zr0, z)) / (10.0 * ((zr1 IS NOT NULL)::INT + (zr0 IS NOT NULL)::INT)) AS gr, (coalesce(zc1, z) - coalesce(zc0, z)) / (10.0 * ((zc1 IS NOT NULL)::INT + (zc0 IS NOT NULL)::INT)) AS gc FROM grad))"""


def slopes(cells: DataFrame, cell: float = 10.0) -> DataFrame:
    """(r, c, valid, slope) in degrees. Neighbours come by equality joins, so no row or column is one task."""
    mean = cells.where("valid").agg(F.avg("z").alias("mean"))  # one row
    filled = cells.join(F.broadcast(mean)).select("r", "c", "valid", F.when(F.col("valid"), F.col("z")).otherwise(F.col("mean")).alias("z"))
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("way")) for a, b, n in ((1, 0, "r0"), (-1, 0, "r1"), (0, 1, "c0"), (0, -1, "c1"))))
    sent = filled.select("r", "c", "z", F.explode(ways).alias("w")).select((F.col("r") + F.col("w.a")).alias("r"), (F.col("c") + F.col("w.b")).alias("c"), F.col("w.way").alias("way"), "z")
    around = sent.groupBy("r", "c").agg(*(F.max(F.when(F.col("way") == n, F.col("z"))).alias(n) for n in ("r0", "r1", "c0", "c1")))
    rows = filled.join(around.hint("merge"), ["r", "c"])

    def gradient(a: str, b: str) -> Column:
        known = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
        return (F.coalesce(b, "z") - F.coalesce(a, "z")) / (cell * known)

    steep = F.degrees(F.atan(F.sqrt(gradient("r0", "r1") ** 2 + gradient("c0", "c1") ** 2)))
    return rows.select("r", "c", "valid", F.when(F.col("valid"), steep).otherwise(F.lit(90.0)).alias("slope"))


@query(f"{with_('terrain')}, {SLOPE} SELECT r, c, round(slope, 6) AS slope FROM slope")
def slope_deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slopes(fixtures.terrain(spark, sf_dir)).select("r", "c", F.round("slope", 6).alias("slope"))


@query(f"{with_('terrain')} SELECT a.r, a.c, max(abs(a.z - b.z)) AS relief FROM terrain a JOIN terrain b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c")
def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.terrain(spark, sf_dir).select("r", "c", "z")
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    sent = cells.select(F.col("z").alias("other"), F.explode(ways).alias("w"), "r", "c").select((F.col("r") + F.col("w.a")).alias("r"), (F.col("c") + F.col("w.b")).alias("c"), "other")
    return cells.join(sent.hint("merge"), ["r", "c"]).groupBy("r", "c").agg(F.max(F.abs(F.col("z") - F.col("other"))).alias("relief"))


# Roads: rows and columns that are multiples of 10 and 30; factor 1.5 and 2. The least share of speed, 0.05, and off a road 0.7.
VEHICLE = {"limit": 85, "base": 10.0, "penalty": 0.6, "on": 1.0, "off": 0.7}


def speed_sql(vehicle: dict, name: str = "") -> str:
    """The speeds of a vehicle, after SLOPE."""
    share = f"least(1.0, slope / {vehicle['limit']})"
    road = "CASE WHEN c % 30 = 0 THEN 2.0 WHEN r % 10 = 0 THEN 1.5 ELSE 1.0 END"
    return f"""speed{name} AS (SELECT r, c, slope, {road} AS road FROM slope WHERE valid AND slope <= {vehicle["limit"]}),
paced{name} AS (SELECT *, {vehicle["base"]} * greatest(0.05, 1 - {vehicle["penalty"]} * {share} * {share}) * CASE WHEN road > 1 THEN road * {vehicle["on"]} ELSE {vehicle["off"]} END AS speed FROM speed{name})"""


SPEED = SLOPE + ", " + speed_sql(VEHICLE)


def speeds(spark: SparkSession, sf_dir: str, vehicle: dict = VEHICLE) -> DataFrame:
    """(r, c, slope, road, speed) of the cells that a vehicle can pass."""
    rows = slopes(fixtures.terrain(spark, sf_dir)).where(F.col("valid") & (F.col("slope") <= vehicle["limit"]))
    road = F.when(F.col("c") % 30 == 0, F.lit(2.0)).when(F.col("r") % 10 == 0, F.lit(1.5)).otherwise(F.lit(1.0))
    share = F.least(F.lit(1.0), F.col("slope") / vehicle["limit"])
    ground = F.when(F.col("road") > 1, F.col("road") * vehicle["on"]).otherwise(F.lit(vehicle["off"]))
    pace = vehicle["base"] * F.greatest(F.lit(0.05), 1 - vehicle["penalty"] * share * share) * ground
    return rows.withColumn("road", road).withColumn("speed", pace).select("r", "c", "slope", "road", "speed")


@query(f"{with_('terrain')}, {SPEED} SELECT r, c, round(speed, 6) AS speed FROM paced")
def speed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeds(spark, sf_dir).select("r", "c", F.round("speed", 6).alias("speed"))


WAYS = "ways AS (SELECT * FROM (VALUES (-1, 0, 1.0::DOUBLE), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (-1, -1, sqrt(2)), (-1, 1, sqrt(2)), (1, -1, sqrt(2)), (1, 1, sqrt(2))) v(a, b, d))"


def walk_sql(name: str = "") -> str:
    """Least travel times from (1, 1) at the speeds paced{name}, after WAYS; a step takes its length over the mean speed of its ends."""
    return f"""grid{name} AS MATERIALIZED (SELECT r, c, speed / 10 AS pace FROM paced{name}),
    edges{name} AS MATERIALIZED (SELECT p.r * 1000 + p.c AS k, g.r * 1000 + g.c AS k2, d / ((p.pace + g.pace) / 2) AS w FROM grid{name} p, ways JOIN grid{name} g ON g.r = p.r + a AND g.c = p.c + b),
    walk{name}(k, cost) USING KEY (k) AS (SELECT 1001, 0.0::DOUBLE FROM grid{name} WHERE r = 1 AND c = 1 UNION
        (SELECT e.k2, min(x.cost + e.w) FROM walk{name} x JOIN edges{name} e ON e.k = x.k LEFT JOIN recurring.walk{name} o ON o.k = e.k2 WHERE o.cost IS NULL OR x.cost + e.w < o.cost - 1e-9 GROUP BY e.k2))"""


def travel(spark: SparkSession, sf_dir: str, vehicle: dict = VEHICLE) -> tuple[DataFrame, DataFrame]:
    """The cells that a vehicle can pass (price is its speed in cells a second), and the least times to reach them."""
    cells = durable(speeds(spark, sf_dir, vehicle).withColumns({"layer": F.lit(0), "price": F.col("speed") / 10}))
    starts = spark.range(1).select(F.lit(0).alias("layer"), F.lit(1).alias("r"), F.lit(1).alias("c"))
    return cells, paths.least_costs(cells, starts, by_speed=True)


@query(f"{with_('terrain')}, {SPEED}, {WAYS}, {walk_sql()} SELECT 0::INT AS layer, (k // 1000)::INT AS r, (k % 1000)::INT AS c, round(cost, 3) AS cost FROM walk")
def shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel(spark, sf_dir)[1].select("layer", "r", "c", F.round("cost", 3).alias("cost"))


# Penalty of zones on each cell: whole inside the inner radius, falling to none at the outer, times the level.
PENALTY = """penalty AS (SELECT t.r, t.c, sum(CASE WHEN d <= r_inner THEN level ELSE level * (1 - (d - r_inner) / (r_outer - r_inner)) END) AS penalty
    FROM (SELECT t.r, t.c, z.r_inner, z.r_outer, z.level, sqrt(((t.r - z.r) * (t.r - z.r) + (t.c - z.c) * (t.c - z.c))::DOUBLE) AS d FROM terrain t JOIN zones z ON (t.r - z.r) * (t.r - z.r) + (t.c - z.c) * (t.c - z.c) <= r_outer * r_outer WHERE t.valid) t GROUP BY t.r, t.c)"""


def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.operators.masks import around

    zones = fixtures.zones(spark, sf_dir).withColumn("range_cells", F.col("r_outer"))
    near = around(fixtures.terrain(spark, sf_dir).where("valid"), zones).withColumn("d", F.sqrt(F.col("d2").cast("double")))
    fall = F.col("level") * (1 - (F.col("d") - F.col("r_inner")) / (F.col("r_outer") - F.col("r_inner")))
    return near.groupBy("r", "c").agg(F.sum(F.when(F.col("d") <= F.col("r_inner"), F.col("level").cast("double")).otherwise(fall)).alias("penalty"))


@query(f"{with_('terrain', 'zones')}, {PENALTY} SELECT r, c, round(penalty, 6) AS penalty FROM penalty")
def zone_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return penalties(spark, sf_dir).select("r", "c", F.round("penalty", 6).alias("penalty"))


@query(f"""{with_('terrain', 'zones')}, {PENALTY}, cells AS (SELECT t.r, t.c, layer, coalesce(p.penalty, 0) * (1 - layer * 0.4) AS risk FROM terrain t LEFT JOIN penalty p USING (r, c), (VALUES (0), (1)) v(layer) WHERE t.valid)
    SELECT layer, count(*) AS passable, round(avg(risk), 6) AS mean_risk, round(max(risk), 6) AS max_risk FROM cells GROUP BY layer""")
def layer_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layered(spark, sf_dir)
    return cells.groupBy("layer").agg(F.count("*").alias("passable"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.round(F.max("risk"), 6).alias("max_risk"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in two layers, the upper with less risk."""
    cells = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c").join(penalties(spark, sf_dir), ["r", "c"], "left")
    cells = cells.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    return cells.select("layer", "r", "c", (F.coalesce("penalty", F.lit(0.0)) * (1 - F.col("layer") * 0.4)).alias("risk"))


LAYER_WALK = """ways AS (SELECT * FROM (VALUES (0, -1, 0, 1.0::DOUBLE, 0.0::DOUBLE), (0, 1, 0, 1.0, 0.0), (0, 0, -1, 1.0, 0.0), (0, 0, 1, 1.0, 0.0), (0, -1, -1, sqrt(2), 0.0), (0, -1, 1, sqrt(2), 0.0), (0, 1, -1, sqrt(2), 0.0), (0, 1, 1, sqrt(2), 0.0), (1, 0, 0, 1.0, 3.0), (-1, 0, 0, 1.0, 3.0)) v(e, a, b, d, up)),
    grid AS MATERIALIZED (SELECT layer, t.r, t.c, coalesce(p.penalty, 0) * (1 - layer * 0.4) AS risk, 1 + coalesce(p.penalty, 0) * (1 - layer * 0.4) AS price FROM terrain t LEFT JOIN penalty p USING (r, c), (VALUES (0), (1)) v(layer) WHERE t.valid),
    edges AS MATERIALIZED (SELECT p.layer * 10000000 + p.r * 1000 + p.c AS k, g.layer * 10000000 + g.r * 1000 + g.c AS k2, d * (p.price + g.price) / 2 + up AS w FROM grid p, ways JOIN grid g ON g.layer = p.layer + e AND g.r = p.r + a AND g.c = p.c + b),
    walk(k, cost) USING KEY (k) AS (SELECT 2002, 0.0::DOUBLE FROM grid WHERE layer = 0 AND r = 2 AND c = 2 UNION
        (SELECT e.k2, min(x.cost + e.w) FROM walk x JOIN edges e ON e.k = x.k LEFT JOIN recurring.walk o ON o.k = e.k2 WHERE o.cost IS NULL OR x.cost + e.w < o.cost - 1e-9 GROUP BY e.k2))"""


def corridor(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cells of two layers (price is one and the risk), and the least costs to reach them from (0, 2, 2)."""
    cells = durable(layered(spark, sf_dir).withColumn("price", 1 + F.col("risk")))
    starts = spark.range(1).select(F.lit(0).alias("layer"), F.lit(2).alias("r"), F.lit(2).alias("c"))
    return cells, paths.least_costs(cells, starts, layers=2, vertical=3.0)


@query(f"{with_('terrain', 'zones')}, {PENALTY}, {LAYER_WALK} SELECT (k // 10000000)::INT AS layer, (k % 10000000 // 1000)::INT AS r, (k % 1000)::INT AS c, round(cost, 3) AS cost FROM walk")
def layered_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridor(spark, sf_dir)[1].select("layer", "r", "c", F.round("cost", 3).alias("cost"))


@query(f"{with_('targets', 'zones')} SELECT target_id, round(sqrt(min((t.r - z.r) * (t.r - z.r) + (t.c - z.c) * (t.c - z.c))::DOUBLE), 6) AS distance FROM targets t, zones z GROUP BY target_id")
def nearest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orograph.operators.masks import around

    zones = fixtures.zones(spark, sf_dir).select("r", "c").distinct()
    # Rings of growing reach, on blocks that grow with it: what has a zone within reach is settled, the rest goes on.
    left = fixtures.targets(spark, sf_dir).select("target_id", "r", "c")
    reach, found, some = 8, None, not zones.isEmpty()
    while found is None or (some and not left.isEmpty()):
        sites = left.select("r", "c").distinct().withColumn("range_cells", F.lit(reach))
        least = around(zones, sites, max(32, reach)).groupBy(F.col("site_r").alias("r"), F.col("site_c").alias("c")).agg(F.min("d2").alias("d2"))
        met = left.join(least, ["r", "c"]).select("target_id", F.round(F.sqrt(F.col("d2").cast("double")), 6).alias("distance"))
        found = met if found is None else found.unionByName(met)
        left, reach = durable(left.join(least, ["r", "c"], "left_anti")), reach * 4
    return found


PAIR = "sums AS (SELECT route_id, sum({0}) / 12.0 AS first_s, sum({0}) / 12.1 + route_id % 3 AS second_s FROM legs GROUP BY route_id)".format(LENGTH)


@query(f"{with_('routes')}, {LEGS}, {PAIR} SELECT route_id, CASE WHEN first_s IS NULL AND second_s IS NULL THEN 'none' WHEN abs(first_s - second_s) <= greatest(5.0, 0.01 * greatest(first_s, second_s)) THEN 'tie' WHEN first_s < second_s THEN 'first' ELSE 'second' END AS winner FROM sums")
def path_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = legs(fixtures.routes(spark, sf_dir)).groupBy("route_id").agg(F.sum(length()).alias("d"))
    sums = sums.select("route_id", (F.col("d") / 12.0).alias("a"), (F.col("d") / 12.1 + F.col("route_id") % 3).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(5.0), 0.01 * F.greatest("a", "b"))
    winner = F.when(F.col("a").isNull() & F.col("b").isNull(), "none").when(near, "tie").when(F.col("a") < F.col("b"), "first").otherwise("second")
    return sums.select("route_id", winner.alias("winner"))


@query(f"{with_('routes')}, {LEGS}, j AS (SELECT route_id, {LENGTH} AS d, y % 10 = 0 OR y2 % 10 = 0 AS road FROM legs WHERE x2 IS NOT NULL) SELECT route_id, round(sum(d), 4) AS distance, round(coalesce(sum(d) FILTER (road), 0), 4) AS road_distance, round(sum(d) - coalesce(sum(d) FILTER (road), 0), 4) AS offroad_distance, round(max(d), 6) AS longest_leg FROM j GROUP BY route_id")
def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs(fixtures.routes(spark, sf_dir)).where("x2 is not null").withColumn("d", length())
    on = F.coalesce(F.sum(F.when((F.col("y") % 10 == 0) | (F.col("y2") % 10 == 0), F.col("d"))), F.lit(0.0))
    out = rows.groupBy("route_id").agg(F.sum("d").alias("d"), on.alias("on"), F.max("d").alias("longest"))
    return out.select("route_id", F.round("d", 4).alias("distance"), F.round("on", 4).alias("road_distance"), F.round(F.col("d") - F.col("on"), 4).alias("offroad_distance"), F.round("longest", 6).alias("longest_leg"))
