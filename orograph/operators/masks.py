"""Mask algebra on cells: range, sector, elevation band and terrain, and the areas they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.scalars import azimuth, in_sector


def around(cells: DataFrame, sites: DataFrame, size: int = 32) -> DataFrame:
    """Cells within the range of each site (r, c, range_cells), with dx, dy and d2.

    Sites and cells meet on square blocks of ``size`` cells a side, each site in the blocks its
    range touches, so this is an equality join and no cross join.
    """
    reach = lambda at, sign: F.floor((F.col(at) + sign * F.col("range_cells")) / size)
    spread = (
        sites.withColumnsRenamed({"r": "site_r", "c": "site_c"})
        .withColumn("br", F.explode(F.sequence(reach("site_r", -1), reach("site_r", 1))))
        .withColumn("bc", F.explode(F.sequence(reach("site_c", -1), reach("site_c", 1))))
    )
    blocks = cells.withColumn("br", F.floor(F.col("r") / size)).withColumn("bc", F.floor(F.col("c") / size))
    dx, dy = F.col("c") - F.col("site_c"), F.col("site_r") - F.col("r")
    near = blocks.join(spread, ["br", "bc"]).drop("br", "bc").withColumns({"dx": dx, "dy": dy})
    return near.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where(F.col("d2") <= F.col("range_cells") * F.col("range_cells"))


def sector(dx: Column, dy: Column, centre: Column, width: Column) -> Column:
    """In a sector; a site's own cell is in it."""
    return ((dx == 0) & (dy == 0)) | in_sector(azimuth(dx.cast("double"), dy.cast("double")), centre, width)


def assemble(cells: DataFrame, sector: Column, band: Column, terrain: Column, domain: Column) -> DataFrame:
    """The masks of a coverage: what would be covered, is known, is seen and is hidden. Their names are fixed values."""
    raw = sector & band
    return cells.withColumns({
        "raw_theoretical": raw,
        "theoretical": raw & domain,
        "unknown": raw & ~domain,
        "visible": raw & domain & terrain,
        "blocked": raw & domain & ~terrain,
    })


def areas(masks: DataFrame, keys: list[str], cell_area: float = 1.0) -> DataFrame:
    """Areas of the masks and their ratios per key."""
    area = lambda name: (F.count_if(name) * F.lit(cell_area)).alias(name + "_area")
    out = masks.groupBy(*keys).agg(*(area(n) for n in ("raw_theoretical", "theoretical", "unknown", "visible", "blocked")))
    over = lambda a, b, empty: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty)), 6)
    return out.withColumn("blocked_ratio", over("blocked_area", "theoretical_area", 0.0)).withColumn("coverage_ratio", over("theoretical_area", "raw_theoretical_area", 1.0))
