"""Queries on the outlines of regions as closed rings and polygons, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators import regions, rings
from orograph.operators.registry import Registry
from orograph.plans import grid, visibility
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

KEYS = ["value", "region"]

#: Regions of ``cells`` (r, c, value); their rings: sides, their successors, least side of the ring, and the walk from it.
REGIONS = """runs AS (SELECT value, r, b, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY value, r ORDER BY c) AS island, c // 256 AS b FROM cells) GROUP BY value, r, b, island),
ids AS MATERIALIZED (SELECT *, r::BIGINT * 2147483648 + c0 AS id FROM runs), down AS MATERIALIZED (SELECT a.id, b.id AS other FROM ids a JOIN (SELECT *, r - 1 AS above FROM ids) b ON a.value = b.value AND b.above = a.r AND a.c0 <= b.c1 AND b.c0 <= a.c1),
links AS MATERIALIZED (SELECT id, other FROM down UNION ALL SELECT other, id FROM down),
reach(id, region) USING KEY (id) AS (SELECT id, id FROM ids UNION (SELECT l.other, min(x.region) FROM reach x JOIN links l ON l.id = x.id JOIN recurring.reach o ON o.id = l.other WHERE x.region < o.region GROUP BY l.other)),
rc AS (SELECT value, region, r, unnest(range(c0, c1 + 1))::BIGINT AS c FROM ids JOIN reach USING (id))"""
RINGS = REGIONS + """,
side AS (SELECT value, region, way, kind, r + a AS kr, c + b AS kc, r + sy AS y, c + sx AS x, (r::BIGINT * 2147483648 + c) * 4 + way AS id
    FROM rc, (VALUES (0, 0, 0, 'h', 0, 0), (1, 0, 1, 'v', 0, 1), (2, 1, 1, 'h', 1, 0), (3, 1, 0, 'v', 0, 0)) s(way, sy, sx, kind, a, b)),
edge AS MATERIALIZED (SELECT any_value(value) AS value, region, any_value(way) AS way, any_value(y) AS y, any_value(x) AS x, any_value(id) AS id FROM side GROUP BY region, kind, kr, kc HAVING count(*) = 1),
ahead AS MATERIALIZED (SELECT *, y + [0, 1, 0, -1][way + 1] AS hy, x + [1, 0, -1, 0][way + 1] AS hx FROM edge),
nx AS MATERIALIZED (SELECT a.id, arg_min(t.id, [1, 0, 9, 2][(t.way - a.way + 4) % 4 + 1]) AS next, arg_min(t.way, [1, 0, 9, 2][(t.way - a.way + 4) % 4 + 1]) AS next_way FROM ahead a JOIN edge t ON t.region = a.region AND t.y = a.hy AND t.x = a.hx GROUP BY a.id),
ringed(id, ring) USING KEY (id) AS (SELECT id, id FROM edge UNION (SELECT n.next, min(x.ring) FROM ringed x JOIN nx n ON n.id = x.id JOIN recurring.ringed o ON o.id = n.next WHERE x.ring < o.ring GROUP BY n.next)),
walk AS (SELECT id, ring, 0::BIGINT AS nth FROM ringed WHERE id = ring UNION ALL SELECT n.next, w.ring, w.nth + 1 FROM walk w JOIN nx n USING (id) WHERE n.next <> w.ring),
whole AS (SELECT a.*, ring, next_way FROM ringed JOIN ahead a USING (id) JOIN nx USING (id)),
full_ AS (SELECT w.*, nth, count(*) OVER (PARTITION BY w.ring) AS n FROM whole w JOIN walk USING (id)),
corner AS (SELECT value, region, ring, n, (nth + 1) % n AS nth, hy AS y, hx AS x FROM full_ WHERE way <> next_way),
ring_ AS (SELECT value, region, ring, count(*) AS length, count(*) FILTER (way <> next_way) AS corners, sum(CASE way WHEN 1 THEN x WHEN 3 THEN -x ELSE 0 END)::BIGINT AS area FROM whole GROUP BY ALL)"""
FEATURE = """, line AS (SELECT value, region, ring, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY nth) || ',' || arg_min('[' || x || ',' || y || ']', nth) || ']' AS text FROM corner GROUP BY ALL)
SELECT value, region, count(*) AS rings, '{"type":"Feature","properties":{"coverage_count":' || value || '},"geometry":{"type":"Polygon","coordinates":[' || string_agg(text, ',' ORDER BY area < 0, ring) || ']}}' AS feature FROM line JOIN ring_ USING (value, region, ring) GROUP BY value, region"""
COUNTED = f"{visibility.COUNTS}, cells AS (SELECT r, c, n AS value FROM counts WHERE n > 0)"


def class_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary sides of the regions of one elevation class, along their rings."""
    return rings.rings(regions.labelled(grid.classes(spark, sf_dir)), KEYS)


@query(f"{with_('terrain')}, {grid.CELLS}, {RINGS} SELECT *, area < 0 AS hole FROM ring_")
def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ring around a region of one elevation class: its length, corners and area; holes have a negative one."""
    return rings.summary(class_rings(spark, sf_dir), KEYS)


@query(f"{with_('terrain')}, {grid.CELLS}, {RINGS} SELECT region, ring, nth, y, x FROM corner")
def ring_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of those rings, in order along them."""
    return rings.corners(class_rings(spark, sf_dir), KEYS).select("region", "ring", "nth", "y", "x")


@query()
def simplified_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners that stay when rings may move by 1.5 cells."""
    return rings.simplified(rings.corners(class_rings(spark, sf_dir), KEYS), KEYS, 1.5).select("region", "ring", "nth", "y", "x")


def polygons(edges: DataFrame) -> DataFrame:
    """A GeoJSON feature of each region: its shell, then its holes, each closed by its first corner."""
    point = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]"))
    points = rings.corners(edges, KEYS).groupBy(*KEYS, "ring").agg(F.array_sort(F.collect_list(F.struct("nth", point.alias("p")))).alias("ps"))
    closed = F.concat(F.lit("["), F.array_join("ps.p", ","), F.lit(","), F.get("ps", F.lit(0))["p"], F.lit("]"))
    lines = points.select(*KEYS, "ring", closed.alias("text")).join(rings.summary(edges, KEYS).select("ring", "hole"), "ring")
    out = lines.groupBy(*KEYS).agg(F.count("*").alias("rings"), F.array_sort(F.collect_list(F.struct("hole", "ring", "text"))).alias("all"))
    head = F.concat(F.lit('{"type":"Feature","properties":{"coverage_count":'), F.col("value").cast("string"), F.lit('},"geometry":{"type":"Polygon","coordinates":['))
    return out.select(*KEYS, "rings", F.concat(head, F.array_join("all.text", ","), F.lit("]}}")).alias("feature"))


@query(f"{with_('terrain', 'stations')}, {visibility.NEAR}, {visibility.SEEN}, {COUNTED}, {RINGS}{FEATURE}")
def count_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the cells that equally many stations see."""
    counts = visibility.multi_station_count(spark, sf_dir).where("n > 0").select("r", "c", F.col("n").alias("value"))
    return polygons(rings.rings(regions.labelled(counts), KEYS))


# By Euler's formula: cells less neighbouring pairs plus full squares of four are the shells less the holes.
@query(f"""{with_('terrain', 'stations')}, {visibility.NEAR}, {visibility.SEEN}, {visibility.COUNTS}, cells AS MATERIALIZED (SELECT r, c, 1 AS value FROM counts WHERE n > 0), {REGIONS},
    k AS MATERIALIZED (SELECT region, r, c FROM rc), p AS (SELECT a.region, count(*) AS pairs FROM k a JOIN (SELECT region, r, c - 1 AS c FROM k UNION ALL SELECT region, r - 1, c FROM k) b USING (region, r, c) GROUP BY a.region),
    q AS (SELECT region, count(*) AS squares FROM (SELECT region, r - a AS r, c - b AS c FROM k, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b) GROUP BY ALL HAVING count(*) = 4) GROUP BY region),
    f AS (SELECT region, count(*) AS n FROM k GROUP BY region)
    SELECT region, 1::BIGINT AS shells, 1 - n + coalesce(pairs, 0) - coalesce(squares, 0) AS holes, n AS area, 4 * n - 2 * coalesce(pairs, 0) AS perimeter FROM f LEFT JOIN p USING (region) LEFT JOIN q USING (region)""")
def union_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of what any station sees, dissolved: shells, holes, area and perimeter."""
    union = visibility.seen(spark, sf_dir).where("visible").select("r", "c", F.lit(1).alias("value")).distinct()
    found = rings.summary(rings.rings(regions.labelled(union), KEYS), KEYS)
    return found.groupBy("region").agg(F.count_if(~F.col("hole")).alias("shells"), F.count_if("hole").alias("holes"), F.sum("area").alias("area"), F.sum("length").alias("perimeter"))
