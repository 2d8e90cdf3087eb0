"""Terrain stored by square tiles, so that a window or a line reads only its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def write_tiles(cells: DataFrame, path: str, side: int = SIDE) -> None:
    """Write cells (r, c, ...) under a folder for each row and column of tiles, one file a tile."""
    placed = cells.withColumns({"tile_r": F.floor(F.col("r") / side).cast("int"), "tile_c": F.floor(F.col("c") / side).cast("int")})
    placed.repartition("tile_r", "tile_c").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, side: int = SIDE) -> DataFrame:
    """The cells of a window, from its tiles only."""
    tiles = F.col("tile_r").between(r0 // side, r1 // side) & F.col("tile_c").between(c0 // side, c1 // side)
    return spark.read.parquet(path).where(tiles & F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("tile_r", "tile_c")


def along_lines(spark: SparkSession, path: str, lines: DataFrame, radius: float, side: int = SIDE) -> DataFrame:
    """Cells within ``radius`` of lines (r0, c0, r1, c1 and more columns), with ``d2``.

    A line names the tiles near it in steps of half a tile, and only those are read: the
    scan is pruned by them when the query runs.
    """
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    parts = F.greatest(F.lit(1), F.ceil(2 * F.greatest(F.abs(dr), F.abs(dc)) / side)).cast("int")
    pieces = lines.withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda v, d, k: F.col(v) + d * k / F.col("_n")
    tile = lambda v, w, d, f, s: F.floor((f(at(v, d, F.col("_k")), at(w, d, F.col("_k") + 1)) + s * radius) / side).cast("int")
    low, high = (lambda v, d: tile(v, v, d, F.least, -1)), (lambda v, d: tile(v, v, d, F.greatest, 1))
    spread = pieces.withColumn("tile_r", F.explode(F.sequence(low("r0", dr), high("r0", dr)))).withColumn("tile_c", F.explode(F.sequence(low("c0", dc), high("c0", dc))))
    # The optimizer prunes a scan by a join only where the other side has a condition.
    spread = spread.drop("_n", "_k").distinct().where(F.col("tile_r") > -(2**31))
    near = spark.read.parquet(path).join(spread, ["tile_r", "tile_c"]).drop("tile_r", "tile_c")
    size = (dr * dr + dc * dc).cast("double")
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("r") - F.col("r0")) * dr + (F.col("c") - F.col("c0")) * dc) / size))).otherwise(F.lit(0.0))
    er, ec = F.col("r") - (F.col("r0") + t * dr), F.col("c") - (F.col("c0") + t * dc)
    return near.withColumn("d2", er * er + ec * ec).where(F.col("d2") <= radius * radius)
