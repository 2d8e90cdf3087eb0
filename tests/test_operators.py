"""Operators on small literal grids, and the identities that hold on any."""

import math

import pytest
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import masks, paths, regions, sight
from orograph.plans import motion, visibility

CELLS = "r int, c int, z double, valid boolean"


def grid(spark, rows, cols, height=lambda r, c: 0.0, valid=lambda r, c: True):
    return spark.createDataFrame([(r, c, float(height(r, c)), valid(r, c)) for r in range(rows) for c in range(cols)], CELLS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ray(spark, r0, c0, h0, r1, c1, h1):
    return spark.createDataFrame([(1, r0, c0, float(h0), r1, c1, float(h1))], "id int, r0 int, c0 int, h0 double, r1 int, c1 int, h1 double")


def test_a_wall_blocks_a_ray_and_height_clears_it(spark):
    cells = grid(spark, 1, 20, lambda r, c: 200 if c == 8 else 0)
    low = sight.profiles(ray(spark, 0, 0, 10, 0, 16, 10), cells, ["id"]).first()
    assert low["worst_clearance"] == -190 and low["worst_at"] == 8 and low["first_hit"] == 8
    assert low["required"] == pytest.approx(10 + 190 * 2)
    assert not sight.visibility(ray(spark, 0, 0, 10, 0, 16, 10), cells, ["id"]).first()["visible"]
    assert sight.visibility(ray(spark, 0, 0, 10, 0, 16, low["required"]), cells, ["id"]).first()["visible"]
    assert sight.least_visible_height(ray(spark, 0, 0, 10, 0, 16, 0), cells, ["id"]).first()["least_height"] == pytest.approx(390)


def test_invalid_cells_and_neighbours_do_not_block(spark):
    cells = grid(spark, 1, 9, lambda r, c: 500, lambda r, c: False)
    assert sight.visibility(ray(spark, 0, 0, 10, 0, 8, 10), cells, ["id"]).first()["visible"]
    assert sight.visibility(ray(spark, 0, 0, 10, 0, 1, 10), cells, ["id"]).first()["visible"]
    assert sight.visibility(ray(spark, 0, 0, 10, 0, 0, 10), cells, ["id"]).first()["visible"]


def test_masks_part_the_area(spark, small):
    m = visibility.coverage(spark, small)
    assert m.where("raw_theoretical <> (theoretical or unknown)").isEmpty()
    assert m.where("unknown and (blocked or visible)").isEmpty()
    assert m.where("theoretical <> (visible or blocked) or (visible and blocked)").isEmpty()
    empty = masks.areas(m.where("station_id < 0"), []).first()
    assert empty["blocked_ratio"] == 0 and empty["coverage_ratio"] == 1


def test_sector_wraps_north(spark):
    cells = grid(spark, 9, 9)
    site = spark.createDataFrame([(4, 4, 4, 350, 90)], "r int, c int, range_cells int, azimuth_deg int, width_deg int")
    near = masks.around(cells, site).where(masks.sector(F.col("dx"), F.col("dy"), F.col("azimuth_deg"), F.col("width_deg")))
    got = {(r["r"], r["c"]) for r in near.collect()}
    assert (0, 4) in got and (4, 4) in got and (1, 5) in got and (8, 4) not in got and (4, 8) not in got


def test_station_counts(spark):
    seen = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0)], "station string, r int, c int")
    counts = {(x["r"], x["c"]): x["n"] for x in seen.groupBy("r", "c").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, 0): 2, (0, 1): 1, (1, 0): 1}


def test_slope_of_a_ramp_and_of_invalid_cells(spark):
    ramp = motion.slopes(grid(spark, 6, 6, lambda r, c: 3 * c, lambda r, c: (r, c) != (5, 5)))
    got = {(x["r"], x["c"]): x["slope"] for x in ramp.collect()}
    assert got[2, 2] == pytest.approx(math.degrees(math.atan(0.3))) and got[0, 0] == pytest.approx(math.degrees(math.atan(0.3))) and got[5, 5] == 90


@pytest.mark.parametrize("tile", [4, 100])
def test_least_costs_go_round_a_wall(spark, tile):
    open_ = [(0, r, c, 1.0) for r in range(10) for c in range(10) if c != 5 or r == 9]
    cells = spark.createDataFrame(open_, "layer int, r int, c int, price double")
    starts = spark.createDataFrame([(0, 0, 0)], "layer int, r int, c int")
    got = {(x["r"], x["c"]): x["cost"] for x in paths.least_costs(cells, starts, tile=tile).collect()}
    want = paths.settle({(k, r, c): p for k, r, c, p in open_}, {(0, 0, 0): 0.0}, 1, 0.0, True)
    assert len(got) == len(want) and all(got[r, c] == pytest.approx(v) for (_, r, c), v in want.items())
    assert got[0, 9] > 14


def test_least_costs_without_a_way(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 2, 1.0)], "layer int, r int, c int, price double")
    starts = spark.createDataFrame([(0, 0, 0), (0, 5, 5)], "layer int, r int, c int")
    assert [tuple(x) for x in paths.least_costs(cells, starts).collect()] == [(0, 0, 0, 0.0)]


def test_layers_are_left_for_a_cheaper_one(spark):
    cells = spark.createDataFrame([(k, 0, c, 5.0 if k == 0 and 0 < c < 9 else 1.0) for k in (0, 1) for c in range(10)], "layer int, r int, c int, price double")
    starts = spark.createDataFrame([(0, 0, 0)], "layer int, r int, c int")
    got = {(x["layer"], x["c"]): x["cost"] for x in paths.least_costs(cells, starts, layers=2, vertical=2.0).collect()}
    assert got[0, 9] == pytest.approx(9 + 2 * 3)


def test_ways_lead_back_to_the_start_and_are_summed(spark):
    # At speed 2 the upper row takes half the time of the lower one; (5, 5) is out of reach.
    cells = spark.createDataFrame([(0, r, c, 2.0 if r == 0 else 1.0) for r in (0, 1) for c in range(9)] + [(0, 5, 5, 1.0)], "layer int, r int, c int, price double")
    starts = spark.createDataFrame([(0, 1, 0)], "layer int, r int, c int")
    costs = paths.least_costs(cells, starts, diagonal=False, by_speed=True)
    before = paths.predecessors(cells, costs, diagonal=False, by_speed=True)
    ends = spark.createDataFrame([("far", 0, 1, 8), ("start", 0, 1, 0), ("none", 0, 5, 5)], "id string, layer int, r int, c int")
    way = {}
    for x in paths.ways(before, ends, "id").collect():
        way.setdefault(x["id"], {})[x["back"]] = (x["r"], x["c"])
    assert way["start"] == {0: (1, 0)} and "none" not in way
    assert [way["far"][k] for k in range(11)] == [(1, 8), *((0, c) for c in range(8, -1, -1)), (1, 0)]
    legs = before.withColumn("steps", F.col("p_layer").isNotNull().cast("long")).withColumn("fast", F.col("price"))
    sums = {(x["r"], x["c"]): x for x in paths.along(legs, ["steps"], ["fast"]).collect()}
    assert len(sums) == 18 and sums[1, 8]["steps"] == 10 and sums[1, 8]["fast"] == 2 and sums[1, 0]["steps"] == 0 and sums[1, 0]["fast"] == 1
    cost = {(x["r"], x["c"]): x["cost"] for x in costs.collect()}
    assert cost[1, 8] == pytest.approx(8 / 2 + 2 / 1.5)


def test_regions_are_connected_by_sides_only(spark):
    rows = ["##.#", "#..#", "..#.", "####"]
    cells = spark.createDataFrame([(r, c, 1) for r, s in enumerate(rows) for c, x in enumerate(s) if x == "#"], "r int, c int, value int")
    parts = regions.components(regions.runs(cells)).groupBy("region").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    assert sorted(x["n"] for x in parts.collect()) == [2, 3, 5]
    assert regions.edges(cells.where("r = 3")).count() == 10


def test_runs_are_cut_at_blocks_but_stay_one_region(spark):
    cells = spark.range(600).select(F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.lit(1).alias("value"))
    runs = regions.runs(cells)
    assert runs.count() == 3 and regions.components(runs).select("region").distinct().count() == 1


def test_scalars(spark):
    rgb = spark.range(1).select(*S.terrarium(F.lit(1000.0))).first()
    assert tuple(rgb) == (131, 232, 0)
    assert one(spark, S.between_angles(F.lit(350.0), F.lit(10.0), F.lit(0.5))) == pytest.approx(0)
    assert one(spark, S.turn(F.lit(350.0), F.lit(10.0))) == pytest.approx(20)
    assert one(spark, S.utm_epsg(F.lit(79.0), F.lit(31.5))) == 32644 and one(spark, S.utm_epsg(F.lit(-180.0), F.lit(-1.0))) == 32701
    east, north = S.utm(F.lit(3.0), F.lit(0.0), F.lit(3), F.lit(False))
    assert one(spark, east) == pytest.approx(500000) and one(spark, north) == pytest.approx(0, abs=1e-6)
    _, north = S.utm(F.lit(9.0), F.lit(45.0), F.lit(9), F.lit(False))
    assert one(spark, north) == pytest.approx(4982950.40, abs=0.01)
    assert one(spark, S.radar_equation_range(F.lit(0.0), F.lit(1e9), F.lit(30.0), F.lit(-100.0), F.lit(None).cast("double"), F.lit(0.0))) is None
    assert one(spark, S.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(90)


def test_cells_that_cost_nothing_still_have_one_way(spark):
    cells = spark.createDataFrame([(0, 0, c, p) for c, p in enumerate((0.0, 0.0, 0.0, 1.0))], "layer int, r int, c int, price double")
    starts = spark.createDataFrame([(0, 0, 3)], "layer int, r int, c int")
    before = paths.predecessors(cells, paths.least_costs(cells, starts))
    assert {r["c"]: r["p_c"] for r in before.collect()} == {0: 1, 1: 2, 2: 3, 3: None}
    back = paths.ways(before, spark.createDataFrame([(1, 0, 0, 0)], "id int, layer int, r int, c int"), "id")
    assert sorted((r["back"], r["c"]) for r in back.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    summed = paths.along(before.withColumn("one", F.lit(1)), ["one"], [])
    assert {r["c"]: r["one"] for r in summed.collect()} == {0: 4, 1: 3, 2: 2, 3: 1}
