"""Queries on shapes, contours, candidates, acceptance and features, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.operators import shapes
from orograph.operators.registry import Registry
from orograph.plans import motion, visibility
from orograph.sources import fixtures, geojson
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

ROADS = "roads AS (SELECT a.station_id, a.r AS r0, a.c AS c0, b.r AS r1, b.c AS c1, 1.2 + a.station_id % 4 * 0.3 AS factor FROM stations a JOIN stations b ON b.station_id = a.station_id + 1)"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight roads from each station to the next, with a speed factor."""
    a = fixtures.stations(spark, sf_dir).select("station_id", F.col("r").alias("r0"), F.col("c").alias("c0"))
    b = a.select((F.col("station_id") - 1).alias("station_id"), F.col("r0").alias("r1"), F.col("c0").alias("c1"))
    return a.join(b, "station_id").withColumn("factor", 1.2 + F.col("station_id") % 4 * 0.3)


@query(f"""{with_('terrain', 'stations')}, {ROADS}, near AS (SELECT t.r, t.c, factor, (t.r - (r0 + k * (r1 - r0))) * (t.r - (r0 + k * (r1 - r0))) + (t.c - (c0 + k * (c1 - c0))) * (t.c - (c0 + k * (c1 - c0))) AS d2
    FROM (SELECT t.r, t.c, x.*, CASE WHEN r0 = r1 AND c0 = c1 THEN 0.0 ELSE greatest(0.0, least(1.0, ((t.r - r0) * (r1 - r0) + (t.c - c0) * (c1 - c0)) / ((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0))::DOUBLE)) END AS k FROM terrain t, roads x) t)
    SELECT r, c, round(max(factor), 6)::DOUBLE AS factor, count(*) AS roads FROM near WHERE d2 <= 2.25 GROUP BY r, c""")
def road_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = shapes.near_segments(fixtures.terrain(spark, sf_dir).select("r", "c"), roads(spark, sf_dir), 1.5)
    return near.groupBy("r", "c").agg(F.round(F.max("factor"), 6).alias("factor"), F.count("*").alias("roads"))


CORNERS = "corners AS (SELECT zone_id, r + 0.3::DOUBLE AS y, c + 0.4::DOUBLE AS x, r_outer + 0.2::DOUBLE AS a FROM zones), e AS (SELECT zone_id, y - a AS y0, x AS x0, y AS y1, x + a AS x1 FROM corners UNION ALL SELECT zone_id, y, x + a, y + a, x FROM corners UNION ALL SELECT zone_id, y + a, x, y, x - a FROM corners UNION ALL SELECT zone_id, y, x - a, y - a, x FROM corners)"


@query(f"""{with_('terrain', 'zones')}, {CORNERS}, hit AS (SELECT t.r, t.c, e.zone_id, count(*) AS n FROM terrain t JOIN e ON ((e.y0 <= t.r AND t.r < e.y1) OR (e.y1 <= t.r AND t.r < e.y0)) AND e.x0 + (t.r - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) > t.c WHERE t.valid GROUP BY ALL)
    SELECT zone_id, count(*) AS cells FROM hit WHERE n % 2 = 1 GROUP BY zone_id""")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = fixtures.zones(spark, sf_dir).select("zone_id", (F.col("r") + 0.3).alias("y"), (F.col("c") + 0.4).alias("x"), (F.col("r_outer") + 0.2).alias("a"))
    y, x, a = F.col("y"), F.col("x"), F.col("a")
    corners = [(y - a, x), (y, x + a), (y + a, x), (y, x - a)]
    sides = F.array(*(F.struct(p[0].alias("y0"), p[1].alias("x0"), q[0].alias("y1"), q[1].alias("x1")) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)))
    cells = shapes.inside(zones.select("zone_id", F.explode(sides).alias("s")).select("zone_id", "s.*"), "zone_id")
    there = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c")
    return cells.join(there, ["r", "c"]).groupBy("zone_id").agg(F.count("*").alias("cells"))


@query(f"{with_('terrain', 'stations')}, near AS (SELECT DISTINCT t.r, t.c FROM terrain t JOIN stations s ON (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c) <= 9) SELECT r, count(*) AS cells FROM near GROUP BY r")
def grown_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    disc = shapes.grown(fixtures.stations(spark, sf_dir).select("r", "c"), 3, [])
    return disc.join(fixtures.terrain(spark, sf_dir).select("r", "c"), ["r", "c"]).groupBy("r").agg(F.count("*").alias("cells"))


@query(f"{with_('terrain')}, v AS (SELECT r, c, z FROM terrain WHERE valid) SELECT a.r, a.c, CASE WHEN b.r > a.r THEN 'down' ELSE 'right' END AS way, round((100.5 - a.z) / (b.z - a.z), 6)::DOUBLE AS t FROM v a JOIN v b ON (b.r = a.r + 1 AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + 1) WHERE (a.z > 100.5) <> (b.z > 100.5)")
def contour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = shapes.contour(fixtures.terrain(spark, sf_dir).where("valid").select("r", "c", "z"), 100.5)
    return points.select("r", "c", "way", F.round("t", 6).alias("t"))


@query(f"{with_('terrain')}, v AS (SELECT r, c FROM terrain WHERE valid), q AS (SELECT a.r, a.c FROM v a JOIN v b ON b.r = a.r AND b.c = a.c + 1 JOIN v d ON d.r = a.r + 1 AND d.c = a.c JOIN v e ON e.r = a.r + 1 AND e.c = a.c + 1), s AS (SELECT 'top' AS face, r FROM q UNION ALL SELECT 'side', q.r FROM q, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) w(a, b) WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.r = q.r + w.a AND o.c = q.c + w.b)) SELECT face, r, count(*) AS n FROM s GROUP BY ALL")
def surface_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.terrain(spark, sf_dir).where("valid").select("r", "c")
    back = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    quads = cells.select("r", "c", F.explode(back).alias("o")).groupBy((F.col("r") - F.col("o.a")).alias("r"), (F.col("c") - F.col("o.b")).alias("c")).agg(F.count("*").alias("n")).where("n = 4").select("r", "c")
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    sides = quads.select("r", (F.explode(ways)).alias("w"), "c").select("r", (F.col("r") + F.col("w.a")).alias("r2"), (F.col("c") + F.col("w.b")).alias("c2"))
    sides = sides.join(quads.select(F.col("r").alias("r2"), F.col("c").alias("c2")), ["r2", "c2"], "left_anti")
    faces = quads.select(F.lit("top").alias("face"), "r").union(sides.select(F.lit("side").alias("face"), "r"))
    return faces.groupBy("face", "r").agg(F.count("*").alias("n"))


@query(f"{with_('routes')}, {motion.LEGS}, s AS (SELECT least((x, y), (x2, y2)) AS p, greatest((x, y), (x2, y2)) AS q FROM legs WHERE x2 IS NOT NULL), d AS (SELECT p, q, count(*) AS n FROM s GROUP BY ALL) SELECT n, count(*) AS segments FROM d GROUP BY n")
def segment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    ends = motion.legs(fixtures.routes(spark, sf_dir)).where("x2 is not null").groupBy(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).agg(F.count("*").alias("n"))
    return ends.groupBy("n").agg(F.count("*").alias("segments"))


@query(f"{with_('terrain')}, rel AS (SELECT a.r, a.c, max(abs(a.z - b.z)) AS relief FROM terrain a JOIN terrain b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c), o AS (SELECT *, row_number() OVER (ORDER BY relief DESC, r, c) AS n FROM rel) SELECT ((n - 1) // 32)::INT AS candidate, r, c, relief FROM o WHERE (n - 1) % 32 = 0 AND n <= 225")
def candidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The best 225, of which every 32nd is a candidate: a top-k report.
    top = motion.relief(spark, sf_dir).orderBy(F.desc("relief"), "r", "c").limit(225)
    ranked = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("relief"), "r", "c")))
    return ranked.where((F.col("n") - 1) % 32 == 0).select(F.floor((F.col("n") - 1) / 32).cast("int").alias("candidate"), "r", "c", "relief")


@query(f"{with_('terrain', 'stations')}, {visibility.NEAR}, {visibility.SEEN}, w AS (SELECT station_id, count(*) FILTER (visible) AS v, count(*) FILTER (NOT visible) AS b FROM seen GROUP BY station_id) SELECT station_id, v > 0 AS has_visible, b > 0 AS has_blocked, v + b >= 100 AS large_enough, (v > 0 AND b > 0 AND v + b >= 100) AS accepted FROM w")
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = visibility.seen(spark, sf_dir).groupBy("station_id").agg(F.count_if("visible").alias("v"), F.count_if(~F.col("visible")).alias("b"))
    checks = {"has_visible": F.col("v") > 0, "has_blocked": F.col("b") > 0, "large_enough": F.col("v") + F.col("b") >= 100}
    return w.withColumns(checks).select("station_id", *checks, (F.col("has_visible") & F.col("has_blocked") & F.col("large_enough")).alias("accepted"))


@query(f"""{with_('terrain', 'stations')}, a AS (SELECT station_id, r, c, range_cells, k, sin(radians(k * 10.0)) AS sx, cos(radians(k * 10.0)) AS sy FROM stations, (SELECT unnest(range(0, 36)) AS k))
    SELECT station_id, k::INT AS k, round(least(range_cells::DOUBLE, CASE WHEN sx > 1e-9 THEN (max_c - c) / sx WHEN sx < -1e-9 THEN c / -sx ELSE 1e9 END, CASE WHEN sy > 1e-9 THEN r / sy WHEN sy < -1e-9 THEN (max_r - r) / -sy ELSE 1e9 END), 6) AS radius FROM a, (SELECT max(r) AS max_r, max(c) AS max_c FROM terrain)""")
def clip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = fixtures.terrain(spark, sf_dir).agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))  # one row
    rays = fixtures.stations(spark, sf_dir).join(F.broadcast(edge)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(35)))).withColumns({"sx": F.sin(F.radians(F.col("k") * 10.0)), "sy": F.cos(F.radians(F.col("k") * 10.0))})
    far = F.lit(1e9)
    across = F.when(F.col("sx") > 1e-9, (F.col("max_c") - F.col("c")) / F.col("sx")).when(F.col("sx") < -1e-9, F.col("c") / -F.col("sx")).otherwise(far)
    along = F.when(F.col("sy") > 1e-9, F.col("r") / F.col("sy")).when(F.col("sy") < -1e-9, (F.col("max_r") - F.col("r")) / -F.col("sy")).otherwise(far)
    return rays.select("station_id", "k", F.round(F.least(F.col("range_cells").cast("double"), across, along), 6).alias("radius"))


@query(f"""{with_('stations')} SELECT station_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || c || ',' || r || ']}},"properties":{{"station_id":' || station_id || ',"status":"' || CASE WHEN station_id % 3 = 0 THEN 'failed' ELSE 'finished' END || '"}}}}' AS feature FROM stations""")
def station_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("station_id") % 3 == 0, "failed").otherwise("finished")
    feature = geojson.point_feature(F.col("c"), F.col("r"), F.struct("station_id", status.alias("status")))
    return fixtures.stations(spark, sf_dir).select("station_id", feature.alias("feature"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing' ELSE 'ok' END AS state FROM events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return fixtures.table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), F.when(props["k"].isNull(), "missing").otherwise("ok").alias("state"))


@query("WITH a AS (SELECT l_orderkey AS task_id, l_linenumber AS kind, count(*) AS n FROM lineitem GROUP BY ALL) SELECT task_id, sha256(string_agg(kind || ':' || n, ',' ORDER BY kind)) AS sha256 FROM a GROUP BY task_id")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fixtures.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), "l_linenumber").agg(F.count("*").alias("n"))
    # A task has at most as many kinds as its contract names.
    listed = parts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["n"].cast("string"))), ",")
    return listed.select("task_id", F.sha2(text, 256).alias("sha256"))


@query(visibility.REGISTRY.oracle["ray_fan"].replace("SELECT station_id, (a * 10)::INT AS azimuth, k AS elevation, coalesce(hit, reach)::INT AS distance, coalesce(stop, 'nominal') AS termination FROM f", "SELECT coalesce(stop, 'nominal') AS termination, count(*) AS rays, max(coalesce(hit, reach))::INT AS longest FROM f GROUP BY 1"))
def ray_terminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.ray_fan(spark, sf_dir).groupBy("termination").agg(F.count("*").alias("rays"), F.max("distance").alias("longest"))


@query(f"{with_('terrain', 'zones')}, {motion.PENALTY}, m AS (SELECT max(penalty) AS top FROM penalty) SELECT CASE WHEN penalty <= 0.33 * top THEN 'low' WHEN penalty <= 0.66 * top THEN 'medium' ELSE 'high' END AS level, count(*) AS cells, round(min(penalty), 6) AS least, round(max(penalty), 6) AS most FROM penalty, m GROUP BY level")
def penalty_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = motion.penalties(spark, sf_dir)
    top = cells.agg(F.max("penalty").alias("top"))  # one row
    level = F.when(F.col("penalty") <= 0.33 * F.col("top"), "low").when(F.col("penalty") <= 0.66 * F.col("top"), "medium").otherwise("high")
    return cells.join(F.broadcast(top)).groupBy(level.alias("level")).agg(F.count("*").alias("cells"), F.round(F.min("penalty"), 6).alias("least"), F.round(F.max("penalty"), 6).alias("most"))


@query(f"{with_('terrain', 'stations')}, {visibility.NEAR}, {visibility.SEEN}, u AS (SELECT DISTINCT r, c FROM seen WHERE visible) SELECT round(avg(r), 6) AS centre_r, round(avg(c), 6) AS centre_c, count(*) AS cells FROM u")
def union_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = visibility.seen(spark, sf_dir).where("visible").select("r", "c").distinct()
    return union.agg(F.round(F.avg("r"), 6).alias("centre_r"), F.round(F.avg("c"), 6).alias("centre_c"), F.count("*").alias("cells"))
