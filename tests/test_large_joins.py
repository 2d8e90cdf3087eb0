"""Grids are joined by shuffles: Spark's estimates of their size are of packed files, and a grid taken for small fills the driver."""

from orograph.operators import mesh
from orograph.plans import grid, motion
from orograph.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_grid_is_broadcast(spark, small):
    cells = fixtures.terrain(spark, small)
    for df in (mesh.solid(cells.where("valid"))[1], grid.resample_bilinear(spark, small), motion.slopes(cells), motion.relief(spark, small)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
