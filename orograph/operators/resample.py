"""Resampling between any two grids.

A target cell is a row with its place (y, x) in the source grid, in cells, whole
at cell centres; how it came by it (another step, an offset, a projection) is the
caller's business. It pulls its four source cells by an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least weight of valid cells that makes a value, a fixed value.
LEAST_WEIGHT = 1e-6


def lattice(rows: DataFrame, height: Column | str, width: Column | str) -> DataFrame:
    """A row (i, j) for each cell of a grid of ``height`` times ``width``, with the other columns of its one row."""
    lines = rows.withColumns({"_h": F.col(height) if isinstance(height, str) else height, "_w": F.col(width) if isinstance(width, str) else width})
    lines = lines.where("_h > 0 and _w > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).repartition("i")
    return lines.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))).drop("_h", "_w")


def bilinear(targets: DataFrame, cells: DataFrame, keys: list[str], need: str = "nearest") -> DataFrame:
    """(keys, z) of the targets (keys, y, x) that have a value from cells (r, c, z, valid).

    The value is the mean of the valid cells among the four around, weighted
    bilinearly over the valid ones. A target has one if their weight is above
    ``LEAST_WEIGHT`` and ``need`` holds: "any" asks for no more, "nearest" for
    the cell nearest to the target to be valid, "all" for all four.
    """
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    part = lambda v, side: F.when(F.col(side) == 0, 1 - (F.col(v) - F.floor(v))).otherwise(F.col(v) - F.floor(v))
    rows = targets.select(*keys, "y", "x").withColumn("_k", F.explode(corners)).select(*keys, "y", "x", "_k.a", "_k.b")
    rows = rows.withColumns({"w": part("y", "a") * part("x", "b"), "r": (F.floor("y") + F.col("a")).cast("int"), "c": (F.floor("x") + F.col("b")).cast("int")})
    # A corner of no weight need not be there.
    rows = rows.where("w > 0").withColumn("mid", (F.col("r") == F.floor(F.col("y") + 0.5)) & (F.col("c") == F.floor(F.col("x") + 0.5)))
    met = rows.join(cells.where("valid").select("r", "c", "z").hint("merge"), ["r", "c"], "left")
    there = F.col("z").isNotNull()
    out = met.groupBy(*keys).agg(
        F.sum(F.when(there, F.col("w"))).alias("weight"), F.sum(F.col("w") * F.col("z")).alias("total"), F.bool_or(F.col("mid") & there).alias("nearest"), F.bool_and(there).alias("all")
    )
    asked = {"any": F.lit(True), "nearest": F.col("nearest"), "all": F.col("all")}[need]
    return out.where((F.col("weight") > LEAST_WEIGHT) & asked).select(*keys, (F.col("total") / F.col("weight")).alias("z"))


def within(cells: Column, side_y: Column, side_x: Column, step: Column, most: int) -> Column:
    """The step that makes a box of ``side_y`` by ``side_x`` at most ``most`` cells: coarsened, again and again, by the root of the excess."""
    def many(s: Column) -> Column:
        return F.ceil(side_y / s) * F.ceil(side_x / s)

    first = F.when(cells <= most, step).otherwise(step * F.sqrt(cells / F.lit(float(most))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda s, _: F.when(many(s) <= most, s).otherwise(s * F.sqrt(many(s) / F.lit(float(most)))))
