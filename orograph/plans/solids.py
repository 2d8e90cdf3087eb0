"""Queries on closed meshes and on where volumes meet the terrain, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators import mesh
from orograph.operators.registry import Registry
from orograph.plans import visibility
from orograph.sources import fixtures
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

SOLID = """k AS (SELECT r, c FROM terrain WHERE valid), q AS (SELECT r - a AS qr, c - b AS qc FROM k, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b) GROUP BY ALL HAVING count(*) = 4),
rim AS (SELECT q.*, n FROM q, (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) w(n, da, db) WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.qr = q.qr + w.da AND o.qc = q.qc + w.db)),
cn AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) v(k, a, b)),
ft AS (SELECT qr, qc, t, pos, k, level FROM q, (VALUES (0, 0, 0, 1), (0, 1, 2, 1), (0, 2, 1, 1), (1, 0, 3, 1), (1, 1, 1, 1), (1, 2, 2, 1), (2, 0, 0, 0), (2, 2, 2, 0), (2, 1, 1, 0), (3, 0, 3, 0), (3, 2, 1, 0), (3, 1, 2, 0)) f(t, pos, k, level)
    UNION ALL SELECT qr, qc, 4 + 2 * n + u, pos, CASE WHEN use = 0 THEN [0, 1, 3, 2][n + 1] ELSE [1, 3, 2, 0][n + 1] END, level FROM rim, (VALUES (0, 0, 0, 1), (0, 1, 1, 1), (0, 2, 1, 0), (1, 0, 0, 1), (1, 1, 1, 0), (1, 2, 0, 0)) f(u, pos, use, level)),
pts AS (SELECT qr, qc, t, pos, qr + a AS r, qc + b AS c, level FROM ft JOIN cn USING (k)),
vert AS (SELECT r, c, level, row_number() OVER (ORDER BY r, c, level) - 1 AS id FROM (SELECT DISTINCT r, c, level FROM pts)),
tri AS (SELECT max(id) FILTER (pos = 0) AS a, max(id) FILTER (pos = 1) AS b, max(id) FILTER (pos = 2) AS c FROM pts JOIN vert USING (r, c, level) GROUP BY qr, qc, t)"""


def terrain_solid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mesh.solid(fixtures.terrain(spark, sf_dir).where("valid"))


@query(f"{with_('terrain')}, {SOLID} SELECT id, r, c, level FROM vert")
def mesh_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the solid over the valid terrain, with dense numbers."""
    return terrain_solid(spark, sf_dir)[0].select("id", "r", "c", "level")


@query(f"{with_('terrain')}, {SOLID} SELECT a, b, c FROM tri")
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain_solid(spark, sf_dir)[1]


@query(f"{with_('terrain')}, {SOLID}, e AS (SELECT least(p, q) AS low, greatest(p, q) AS high, count(*) FILTER (p < q) AS up, count(*) FILTER (p > q) AS down FROM (SELECT a AS p, b AS q FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT c, a FROM tri) GROUP BY ALL) SELECT up, down, count(*) AS edges, up = down AS closed FROM e GROUP BY ALL")
def mesh_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often triangles run along the edges each way: a closed mesh has as many one way as the other."""
    found = mesh.edges(terrain_solid(spark, sf_dir)[1])
    return found.groupBy("up", "down").agg(F.count("*").alias("edges")).withColumn("closed", F.col("up") == F.col("down"))


@query(f"""{with_('terrain', 'stations')}, {visibility.NEAR}, p AS (SELECT n.station_id, n.r, n.c, g.z + n.height_m - sqrt(n.d2) * 10 * tan(radians(8.0)) - n.z AS d FROM near n JOIN terrain g ON g.r = n.site_r AND g.c = n.site_c WHERE n.valid),
    qd AS (SELECT station_id, r - a AS qr, c - b AS qc, max(d) FILTER (a = 0 AND b = 0) AS d0, max(d) FILTER (a = 0 AND b = 1) AS d1, max(d) FILTER (a = 1 AND b = 0) AS d2, max(d) FILTER (a = 1 AND b = 1) AS d3 FROM p, (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b) GROUP BY ALL HAVING count(*) = 4),
    s AS (SELECT station_id, qr, qc, half, k, qr + y0 + da / (da - db) * (y1 - y0) AS y, qc + x0 + da / (da - db) * (x1 - x0) AS x FROM (SELECT *, [d0, d1, d2, d3][lo + 1] AS da, [d0, d1, d2, d3][hi + 1] AS db FROM qd,
        (VALUES (0, 0, 0, 2, 0, 0, 1, 0), (0, 1, 1, 2, 0, 1, 1, 0), (0, 2, 0, 1, 0, 0, 0, 1), (1, 0, 1, 3, 0, 1, 1, 1), (1, 1, 1, 2, 0, 1, 1, 0), (1, 2, 2, 3, 1, 0, 1, 1)) e(half, k, lo, hi, y0, x0, y1, x1)) WHERE (da > 0) <> (db > 0))
    SELECT station_id, qr, qc, half, round(arg_min(y, k), 6) AS y0, round(arg_min(x, k), 6) AS x0, round(arg_max(y, k), 6) AS y1, round(arg_max(x, k), 6) AS x1 FROM s GROUP BY ALL HAVING count(*) = 2""")
def contact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the cone eight degrees below each station's horizon meets the terrain in its range."""
    cells = fixtures.terrain(spark, sf_dir)
    ground = cells.select(F.col("r").alias("site_r"), F.col("c").alias("site_c"), F.col("z").alias("site_z"))
    near = visibility.near(spark, sf_dir).where("valid").join(ground, ["site_r", "site_c"])
    cone = F.col("site_z") + F.col("height_m") - F.sqrt(F.col("d2").cast("double")) * 10 * F.tan(F.radians(F.lit(8.0)))
    found = mesh.contact(near.select("station_id", "r", "c", (cone - F.col("z")).alias("d")), ["station_id"])
    return found.select("station_id", "qr", "qc", "half", *(F.round(v, 6).alias(v) for v in ("y0", "x0", "y1", "x1")))
