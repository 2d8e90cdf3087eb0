"""Regions of equal value on a grid: runs, connected components, edges and outlines.

Cells of a row join into runs (gaps and islands), runs of neighbouring rows join
where they overlap: inside a tile in one task, and what meets at the borders of
tiles by star contraction. Runs are cut at multiples of a block's width, so that
no row is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators import components as graph
from orograph.operators.checkpoint import durable

BLOCK = 256
#: Rows of a tile, which is a block wide.
HEIGHT = 512


def runs(cells: DataFrame) -> DataFrame:
    """(value, r, c0, c1) of the runs of cells (r, c, value) with consecutive columns and one value."""
    w = Window.partitionBy("value", "r", "b").orderBy("c")
    rows = cells.withColumn("b", F.floor(F.col("c") / BLOCK)).withColumn("island", F.col("c") - F.row_number().over(w))
    return rows.groupBy("value", "r", "b", "island").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).select("value", "r", "c0", "c1")


def _joined(pieces: pa.Table) -> pa.Table:
    """Pieces of runs of one tile with ``root``, the smallest run number that they are joined to inside it."""
    whole = lambda n: pieces[n].to_numpy().astype(np.int64)
    value = pc.fill_null(pieces["value"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    r, first, last, ids = whole("r"), whole("first"), whole("last"), whole("id")
    left, wide = first.min(), last.max() - first.min() + 3
    row = (value * (r.max() - r.min() + 2) + r - r.min()) * wide - left
    order = np.argsort(row + first)
    starts, ends, below = (row + first)[order], (row + last)[order], wide
    known = (value >= 0)[order]
    low, high = np.searchsorted(ends, starts + below), np.searchsorted(starts, ends + below, "right")
    many = np.where(known, np.maximum(high - low, 0), 0)
    a = np.repeat(np.arange(len(order)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    beside = np.flatnonzero((starts[1:] == ends[:-1] + 1) & known[1:])
    root = list(range(len(order)))

    def find(x):
        while (up := root[x]) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip([*a.tolist(), *beside.tolist()], [*b.tolist(), *(beside + 1).tolist()], strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)  # of one value, so the first in order has the smallest number
    out = np.empty(len(order), np.int64)
    out[order] = ids[order][[find(x) for x in range(len(order))]]
    return pieces.append_column("root", pa.array(out))


def components(runs: DataFrame) -> DataFrame:
    """Runs with ``region``, the smallest run number of their 4-connected component.

    A task joins the runs of one tile, and only what meets across the borders of
    tiles is linked in rounds; so links grow with the borders, not with the runs.
    """
    # A number that tells a run and orders runs by row and column.
    rows = runs.withColumn("id", F.col("r").cast("long") * 2**31 + F.col("c0"))
    opens = F.col("block") * BLOCK
    pieces = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK))))
    pieces = pieces.withColumns({"first": F.greatest(F.col("c0").cast("long"), opens), "last": F.least(F.col("c1").cast("long"), opens + BLOCK - 1)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", root long"
    joined = durable(pieces.groupBy(F.floor(F.col("r") / HEIGHT), "block").applyInArrow(_joined, schema))
    at = F.pmod("r", F.lit(HEIGHT))
    above = joined.where(at == HEIGHT - 1).select("value", (F.col("r") + 1).alias("r"), "block", F.col("root").alias("b"), F.col("first").alias("d0"), F.col("last").alias("d1"))
    down = joined.where(at == 0).join(above, ["value", "r", "block"]).where("first <= d1 and d0 <= last").select(F.col("root").alias("a"), "b")
    before = joined.where(F.col("last") == opens + BLOCK - 1).select("value", "r", (F.col("block") + 1).alias("block"), F.col("root").alias("b"))
    beside = joined.where(F.col("first") == opens).join(before, ["value", "r", "block"]).select(F.col("root").alias("a"), "b")
    roots = graph.components(down.union(beside)).select(F.col("node").alias("root"), F.col("root").alias("region"))
    told = joined.where(F.col("block") == F.floor(F.col("c0") / BLOCK)).join(roots, "root", "left")
    return told.withColumn("region", F.coalesce("region", "root")).select(*runs.columns, "region")


def labelled(cells: DataFrame) -> DataFrame:
    """Cells (r, c, value) with the ``region`` they belong to."""
    joined = components(runs(cells))
    return joined.select("value", "region", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def edges(cells: DataFrame) -> DataFrame:
    """Unit edges (value, kind, r, c) between a value's cells and others: each is of one cell only."""
    sides = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in (("h", 0, 0), ("h", 1, 0), ("v", 0, 0), ("v", 0, 1))))
    sent = cells.withColumn("s", F.explode(sides)).select("value", F.col("s.kind").alias("kind"), (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    return sent.groupBy("value", "kind", "r", "c").agg(F.count("*").alias("n")).where("n = 1").drop("n")
