"""Tiles are settled on arrays, to the costs that a heap gives, and a round opens no other tile."""

import heapq
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import paths
from orograph.operators.checkpoint import Rounds


@pytest.mark.parametrize("layers, vertical, by_speed", [(1, 0.0, True), (2, 3.0, False), (1, 0.0, False)])
def test_costs_are_those_of_a_heap(layers, vertical, by_speed):
    draw = np.random.default_rng(layers)
    cells = np.array([(k, r, c) for k in range(layers) for r in range(30) for c in range(17)])
    at, wide, floor = paths.box(cells, layers)
    price = np.zeros(floor * layers)
    price[at] = np.where(draw.random(len(at)) < 0.2, 0, draw.choice([0.001, 0.5, 1.0, 9.0], len(at)))
    best, seeds = np.full(len(price), inf), [(int(at[3]), 1.5), (int(at[3]), 0.5), (int(at[200]), 0.0), (int(at[-1]), 4.0)]
    paths.spread(price, best, np.array([k for k, _ in seeds]), np.array([v for _, v in seeds]), wide, floor, vertical, True, by_speed)
    want, heap = np.full(len(price), inf), [(v, k) for k, v in seeds if price[k]]
    while heap:
        v, k = heapq.heappop(heap)
        if v >= want[k]:
            continue
        want[k] = v
        moves = [(k + a * wide + b, d, 0.0) for a, b, d in paths.ALL_STEPS] + [(k + f, 1.0, vertical) for f in (floor, -floor) if layers > 1]
        for to, d, up in moves:
            if 0 <= to < len(price) and price[to]:
                mean = (price[k] + price[to]) / 2
                heapq.heappush(heap, (v + (d / mean if by_speed else d * mean) + up, to))
    assert np.array_equal(best, want) and np.isfinite(want).sum() > 300


def test_a_round_opens_the_tiles_it_asks_for(spark):
    kept = Rounds()
    table = kept.parted(spark.range(100).withColumn("tile", F.col("id") % 10 - 3), "tile")
    some = table.where(F.col("tile").isin([-3, 4]))
    assert sorted(x["id"] % 10 for x in some.collect()) == [0] * 10 + [7] * 10
    assert {f.rsplit("tile=", 1)[1].split("/")[0] for f in (x["f"] for x in some.select(F.input_file_name().alias("f")).collect())} == {"-3", "4"}
    kept.drop()


def test_predecessors_are_told_across_tiles(spark, monkeypatch):
    cells = spark.createDataFrame([(k, r, c, 1.0 + (r * 7 + c * 3 + k) % 5, f"{r}-{c}") for k in (0, 1) for r in range(12) for c in range(9) if (r * 3 + c) % 7], "layer int, r int, c int, price double, name string")
    costs = paths.least_costs(cells, spark.createDataFrame([(0, 0, 1)], "layer int, r int, c int"), layers=2, vertical=3.0)
    known = {(x["layer"], x["r"], x["c"]): x for x in cells.join(costs, paths.CELL).collect()}
    monkeypatch.setattr(paths, "TILE_CELLS", 32)
    got = paths.predecessors(cells, costs, layers=2, vertical=3.0)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    moves = [(0, a, b, d, 0.0) for a, b, d in paths.ALL_STEPS] + [(k, 0, 0, 1.0, 3.0) for k in (-1, 1)]
    for x in got.collect():
        at, here = (x["layer"], x["r"], x["c"]), known.pop((x["layer"], x["r"], x["c"]))
        assert x["name"] == here["name"] and x["cost"] == here["cost"]
        near = [((at[0] + e, at[1] + a, at[2] + b), d, up) for e, a, b, d, up in moves]
        known[at] = here
        offers = [(round(known[p]["cost"] + d * (known[p]["price"] + here["price"]) / 2 + up, 6), p) for p, d, up in near if p in known]
        assert (x["p_layer"], x["p_r"], x["p_c"]) == (min(offers)[1] if here["cost"] else (None, None, None))
    assert got.count() == len(known) > 150
