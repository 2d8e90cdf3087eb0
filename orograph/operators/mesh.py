"""Closed triangle meshes over cells, and where two surfaces over the same cells meet.

A square between four neighbouring cell centres is a quad of two triangles. A
solid has a top and a bottom over its quads and walls where no quad goes on.
Corners become vertices with dense numbers: rows are dealt to ranges of the
order, numbered inside each, and one row a range says where it begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators.checkpoint import durable

#: Corners of a quad, and its two triangles over them.
CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]
TRIANGLES = [(0, 2, 1), (3, 1, 2)]
#: Sides of a quad: the way to the quad beyond, and the corners from the one to the other as the top goes round.
SIDES = [((-1, 0), (0, 1)), ((0, 1), (1, 3)), ((1, 0), (3, 2)), ((0, -1), (2, 0))]


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows with dense numbers from 0 in an order that tells all of them apart."""
    placed = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_many"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = counts.select("_range", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + nth).drop("_range", "_start")  # one small row a range


def quads(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, qr, qc and each value at the corners as value_0 to value_3) of points (keys, r, c) that stand at all four corners of a quad."""
    corner = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(CORNERS)))
    sent = points.withColumn("_o", F.explode(corner)).withColumns({"qr": F.col("r") - F.col("_o.a"), "qc": F.col("c") - F.col("_o.b")})
    at = [F.max(F.when(F.col("_o.k") == k, F.col(v))).alias(f"{v}_{k}") for v in values for k in range(4)]
    return sent.groupBy(*keys, "qr", "qc").agg(F.count("*").alias("_n"), *at).where("_n = 4").drop("_n")


def solid(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, r, c, level) and triangles (a, b, c of vertex ids) of the solid over cells (r, c).

    Level 1 is the top and 0 the bottom; triangles of the top go round one way,
    those of the bottom the other, and each wall closes both.
    """
    flat = durable(quads(cells.select("r", "c"), [], []))
    corner = lambda k, level: F.struct((F.col("qr") + CORNERS[k][0]).alias("r"), (F.col("qc") + CORNERS[k][1]).alias("c"), F.lit(level).alias("level"))
    faces = [F.struct(*(corner(k, 1).alias(n) for n, k in zip("abc", t, strict=True))) for t in TRIANGLES]
    faces += [F.struct(*(corner(k, 0).alias(n) for n, k in zip("abc", (t[0], t[2], t[1]), strict=True))) for t in TRIANGLES]
    both = flat.select(F.explode(F.array(*faces)).alias("t"))
    ways = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("da"), F.lit(b).alias("db")) for n, ((a, b), _) in enumerate(SIDES)))
    asked = flat.withColumn("w", F.explode(ways)).withColumns({"nr": F.col("qr") + F.col("w.da"), "nc": F.col("qc") + F.col("w.db")})
    rim = asked.join(flat.select(F.col("qr").alias("nr"), F.col("qc").alias("nc")).hint("merge"), ["nr", "nc"], "left_anti")
    walls = None
    for n, (_, (p, q)) in enumerate(SIDES):
        # The top triangle runs from q to p along this side, so its wall runs from p to q.
        one = F.struct(corner(p, 1).alias("a"), corner(q, 1).alias("b"), corner(q, 0).alias("c"))
        two = F.struct(corner(p, 1).alias("a"), corner(q, 0).alias("b"), corner(p, 0).alias("c"))
        part = rim.where(F.col("w.n") == n).select(F.explode(F.array(one, two)).alias("t"))
        walls = part if walls is None else walls.union(part)
    faces = durable(both.union(walls).withColumn("face", F.monotonically_increasing_id()))
    corners = faces.select(F.explode(F.array("t.a", "t.b", "t.c")).alias("v")).select("v.*").distinct()
    vertices = durable(numbered(corners, ["r", "c", "level"]))
    place = F.struct("r", "c", "level")
    ends = faces.select("face", F.posexplode(F.array("t.a", "t.b", "t.c")).alias("nth", "v"))
    named = ends.join(vertices.select("id", place.alias("v")).hint("merge"), "v").groupBy("face")
    return vertices, named.agg(*(F.max(F.when(F.col("nth") == k, F.col("id"))).alias(n) for k, n in enumerate("abc"))).drop("face")


def edges(triangles: DataFrame) -> DataFrame:
    """Edges (low, high) with how often triangles run along them upwards (``up``) and downwards (``down``)."""
    each = F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")))
    sent = triangles.select(F.explode(each).alias("e")).select(F.least("e.p", "e.q").alias("low"), F.greatest("e.p", "e.q").alias("high"), (F.col("e.p") < F.col("e.q")).alias("rises"))
    return sent.groupBy("low", "high").agg(F.count_if("rises").alias("up"), F.count_if(~F.col("rises")).alias("down"))


def contact(points: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, qr, qc, half, y0, x0, y1, x1) along which a surface meets another.

    ``d`` at points (keys, r, c, d) is the one less the other; a triangle in which
    its sign changes is crossed from one of its sides to another.
    """
    rows = quads(points, keys, ["d"])
    halves = []
    for half, corners in enumerate(TRIANGLES):
        crossings = []
        for i, j in zip(corners, corners[1:] + corners[:1], strict=True):
            low, high = min(i, j), max(i, j)
            a, b = F.col(f"d_{low}"), F.col(f"d_{high}")
            t = a / (a - b)
            y = F.col("qr") + CORNERS[low][0] + t * (CORNERS[high][0] - CORNERS[low][0])
            x = F.col("qc") + CORNERS[low][1] + t * (CORNERS[high][1] - CORNERS[low][1])
            crossings.append(F.when((a > 0) != (b > 0), F.struct(y.alias("y"), x.alias("x"))))
        halves.append(F.struct(F.lit(half).alias("half"), F.filter(F.array(*crossings), lambda p: p.isNotNull()).alias("ps")))
    met = rows.select(*keys, "qr", "qc", F.explode(F.array(*halves)).alias("h")).where(F.size("h.ps") == 2)
    p, q = F.get("h.ps", F.lit(0)), F.get("h.ps", F.lit(1))
    return met.select(*keys, "qr", "qc", "h.half", p["y"].alias("y0"), p["x"].alias("x0"), q["y"].alias("y1"), q["x"].alias("x1"))
