"""Shapes on a grid: cells near segments, inside polygons, grown by a radius, and contours between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32


def near_segments(cells: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Cells (r, c) within ``radius`` of segments (r0, c0, r1, c1 and more columns), with ``d2``.

    A segment meets the blocks of cells that its box touches, so this is an
    equality join.
    """
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / BLOCK), F.floor((F.greatest(a, b) + radius) / BLOCK))
    spread = segments.withColumn("br", F.explode(span("r0", "r1"))).withColumn("bc", F.explode(span("c0", "c1")))
    near = cells.withColumn("br", F.floor(F.col("r") / BLOCK)).withColumn("bc", F.floor(F.col("c") / BLOCK)).join(spread, ["br", "bc"]).drop("br", "bc")
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    size = (dr * dr + dc * dc).cast("double")
    along = (F.col("r") - F.col("r0")) * dr + (F.col("c") - F.col("c0")) * dc
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / size))).otherwise(F.lit(0.0))
    er, ec = F.col("r") - (F.col("r0") + t * dr), F.col("c") - (F.col("c0") + t * dc)
    return near.withColumn("d2", er * er + ec * ec).where(F.col("d2") <= radius * radius)


def inside(edges: DataFrame, key: str) -> DataFrame:
    """Cells (key, r, c) whose centres lie inside polygons given by edges (key, y0, x0, y1, x1), even-odd.

    Centres are at whole numbers. An edge crosses the rows between its ends; the
    crossings of a row, in order, pair up to intervals of columns.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumns({"low": F.ceil(low), "high": F.ceil(high) - 1}).where("low <= high").withColumn("r", F.explode(F.sequence("low", "high")))
    x = F.col("x0") + (F.col("r") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = rows.withColumn("x", x).groupBy(key, "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = crossed.withColumn("p", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))))
    first, last = F.ceil(F.get("xs", F.col("p"))), F.ceil(F.get("xs", F.col("p") + 1)) - 1
    columns = pairs.withColumns({"first": first, "last": last}).where("first <= last").withColumn("c", F.explode(F.sequence("first", "last")))
    return columns.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))


def grown(cells: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Distinct cells within a radius of the given ones."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    sent = cells.withColumn("o", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))))
    return sent.select(*keys, (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")).distinct()


def contour(cells: DataFrame, level: float) -> DataFrame:
    """Points (r, c, way, t) where the value crosses a level between a cell and its lower or right neighbour."""
    ways = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("way")) for a, b, w in ((1, 0, "down"), (0, 1, "right"))))
    asked = cells.select("r", "c", "z", F.explode(ways).alias("w")).select("r", "c", "z", (F.col("r") + F.col("w.a")).alias("r2"), (F.col("c") + F.col("w.b")).alias("c2"), F.col("w.way").alias("way"))
    other = cells.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2"))
    met = asked.join(other, ["r2", "c2"]).where((F.col("z") > level) != (F.col("z2") > level))
    return met.select("r", "c", "way", ((level - F.col("z")) / (F.col("z2") - F.col("z"))).alias("t"))
