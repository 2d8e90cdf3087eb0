"""Footprints are counted tile by tile, and tiles and parts alter nothing."""

from orograph.plans import motion


def test_tiles_and_parts_alter_no_count(spark, small):
    for union in (False, True):
        whole = {tuple(x) for x in motion.footprints(spark, small, union).collect()}
        assert len(whole) > 5
        assert {tuple(x) for x in motion.footprints(spark, small, union, side=8, most=20).collect()} == whole


def test_no_row_for_each_cell_seen(spark, small):
    plan = motion.footprints(spark, small, True)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastHashJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]
