"""Masks of many sites as bitmaps: one 32-bit word for each site and block of 4 x 8 cells.

Union, overlap and counts come from and, or and the number of set bits of words,
and a point is looked up by its bit. Words of one block are first folded in parts,
so that a block that very many sites see is no one task's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, WIDE, PARTS = 4, 8, 16


def _place(r: Column, c: Column) -> Column:
    return (F.pmod(r, F.lit(HIGH)) * WIDE + F.pmod(c, F.lit(WIDE))).cast("int")


def blocks(r: str = "r", c: str = "c") -> dict[str, Column]:
    return {"br": F.floor(F.col(r) / HIGH).cast("int"), "bc": F.floor(F.col(c) / WIDE).cast("int")}


def packed(cells: DataFrame, keys: list[str], masks: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """(keys, br, bc, a word for each mask, and aggregates ``also`` of the block's rows) of cells (keys, r, c)."""
    rows = cells.withColumns(blocks()).withColumn("_bit", _place(F.col("r"), F.col("c")))
    word = lambda m: F.coalesce(F.bit_or(F.when(m, F.expr("shiftleft(1L, _bit)"))), F.lit(0).cast("long"))
    return rows.groupBy(*keys, "br", "bc").agg(*(word(m).alias(n) for n, m in masks.items()), *(v.alias(n) for n, v in (also or {}).items()))


def folded(words: DataFrame, key: str, word: str) -> DataFrame:
    """Per block the cells set in any word (``one``) and in two or more (``two``), as words."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("one"), zero.alias("two"))

    def both(a: Column, b: Column) -> Column:
        two = a["two"].bitwiseOR(b["two"]).bitwiseOR(a["one"].bitwiseAND(b["one"]))
        return F.struct(a["one"].bitwiseOR(b["one"]).alias("one"), two.alias("two"))

    fold = lambda name: F.aggregate(F.col(name), start, both)
    rows = words.select("br", "bc", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part"), F.struct(F.col(word).alias("one"), zero.alias("two")).alias("w"))
    parts = rows.groupBy("br", "bc", "part").agg(F.collect_list("w").alias("ws")).select("br", "bc", fold("ws").alias("w"))
    return parts.groupBy("br", "bc").agg(F.collect_list("w").alias("ws")).select("br", "bc", fold("ws").alias("w")).select("br", "bc", "w.one", "w.two")


def at(points: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """Points (r, c) joined with the words whose bit there is set."""
    asked = points.withColumns(blocks()).withColumn("_bit", _place(F.col("r"), F.col("c")))
    return asked.join(words, ["br", "bc"]).where(F.expr(f"shiftright({word}, _bit) & 1 = 1")).drop("br", "bc", "_bit")
