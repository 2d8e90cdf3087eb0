"""Overviews of a grid at halving resolutions, and what is read from them.

A level is made from the one below it, so all levels together move a third more
rows than the first. Level 0 is the grid itself; a cell of level k stands for a
square of 2**k cells a side, with the count, sum and extremes of its valid ones,
so that every level is exactly what the base cells would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.operators.checkpoint import durable


def base(cells: DataFrame) -> DataFrame:
    """Level 0 of cells (r, c, z, valid): (tr, tc, n, total, low, high) of the valid ones."""
    z = F.col("z")
    return cells.where("valid").select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.lit(1).cast("long").alias("n"), z.alias("total"), z.alias("low"), z.alias("high"))


def halved(level: DataFrame) -> DataFrame:
    """The next level of a level."""
    half = lambda v: F.shiftright(v, 1).alias(v)
    return level.groupBy(half("tr"), half("tc")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def levels(cells: DataFrame, most: int = 30) -> list[DataFrame]:
    """All levels from 0 up to the one of a single cell, or of none."""
    out = [base(cells)]
    while len(out) <= most:
        last = durable(halved(out[-1]))
        out.append(last)
        if len(last.head(2)) < 2:
            break
    return out


def stacked(found: list[DataFrame]) -> DataFrame:
    """Levels as one table, with their number ``level``."""
    out = found[0].withColumn("level", F.lit(0))
    for k, rows in enumerate(found[1:], 1):
        out = out.unionByName(rows.withColumn("level", F.lit(k)))
    return out


def level_for(step: Column, top: int) -> Column:
    """The coarsest level that is not coarser than ``step`` cells."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.log2(step) + 1e-9))).cast("int")


def filled(cells: DataFrame, reach: int = 2) -> DataFrame:
    """Every invalid cell (r, c) with a ``z`` from valid ones near it, however far they are.

    At each level a hole looks at the squares around its own, up to ``reach``
    away, and takes the mean of their values weighted by their valid cells over
    the squared distance of their centres. A hole is done at the first level at
    which it sees anything, so a wide hole takes as many rounds as its width has
    bits, and only holes still open go on. Null only if no cell is valid.
    """
    found = levels(cells)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    holes, done = cells.where("not valid").select("r", "c"), None
    for k, level in enumerate(found):
        seen = holes.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
        centre = lambda v, k=k: (F.col(v) + 0.5) * 2**k - 0.5
        at = seen.withColumns({"tr": F.shiftright("r", k) + F.col("a"), "tc": F.shiftright("c", k) + F.col("b")})
        met = at.join(level, ["tr", "tc"], "left").withColumn("d2", (centre("tr") - F.col("r")) ** 2 + (centre("tc") - F.col("c")) ** 2)
        z = F.sum(F.col("total") / F.col("d2")) / F.sum(F.when(F.col("n").isNotNull(), F.col("n") / F.col("d2")))
        new = durable(met.groupBy("r", "c").agg(z.alias("z")))
        last = k + 1 == len(found)
        got = new if last else new.where("z is not null")
        done = got if done is None else done.unionByName(got)
        holes = new.where("z is null").select("r", "c")
        if last or holes.isEmpty():
            break
    return done
