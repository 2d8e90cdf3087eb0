"""Bitmaps, running heights, swept sight and pruned reads on small grids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orograph import catalog
from orograph.operators import bitmaps, checkpoint, sight
from orograph.sources import fixtures, tiles

CELLS = "r int, c int, z double, valid boolean"


def grid(spark, rows, cols, height, valid=lambda r, c: True):
    return spark.createDataFrame([(r, c, float(height(r, c)), valid(r, c)) for r in range(rows) for c in range(cols)], CELLS)


def bits(word):
    return {k for k in range(32) if word >> k & 1}


def test_words_fold_to_union_and_overlap(spark):
    draw = random.Random(2)
    cells = [(s, draw.randrange(-9, 20), draw.randrange(-9, 30)) for s in range(70) for _ in range(15)]
    words = bitmaps.packed(spark.createDataFrame(cells, "s int, r int, c int"), ["s"], {"seen": F.lit(True), "none": F.lit(False)})
    times = Counter((r, c) for s, r, c in set(cells))
    one, two = set(), set()
    for w in bitmaps.folded(words, "s", "seen").collect():
        for name, to in (("one", one), ("two", two)):
            to |= {(w["br"] * 4 + k // 8, w["bc"] * 8 + k % 8) for k in bits(w[name])}
    assert one == set(times) and two == {at for at, n in times.items() if n > 1}
    assert words.where("none <> 0").isEmpty()
    asked = spark.createDataFrame([(r, c) for r in range(-9, 20) for c in range(-9, 30)], "r int, c int")
    got = Counter((x["r"], x["c"]) for x in bitmaps.at(asked, words, "seen").collect())
    assert got == times


@pytest.mark.parametrize("block", [256, 3])
def test_running_height_is_the_highest_need_so_far(spark, block):
    heights = [0, 5, 3, 40, 2, 60, 1, 1, 90, 0]
    cells = grid(spark, 1, 10, lambda r, c: heights[c], lambda r, c: c != 8)
    rays = spark.createDataFrame([(1, 0, 0, 10.0, 0, 9, 0.0)], "id int, r0 int, c0 int, h0 double, r1 int, c1 int, h1 double")
    got = {r["i"]: r["required"] for r in sight.running(rays, cells, ["id"], block).collect()}
    top, want = float("-inf"), {}
    for i in range(1, 9):
        if i != 8:
            top = max(top, 10 + (heights[i] - 10) * 9 / i)
            want[i] = top
    assert got == pytest.approx(want)
    assert got[7] == pytest.approx(sight.profiles(rays, cells, ["id"]).first()["required"])


def test_swept_sight_is_hidden_behind_a_wall(spark):
    cells = grid(spark, 21, 21, lambda r, c: 30 if c == 13 else 0, lambda r, c: (r, c) != (5, 5))
    site = spark.createDataFrame([(1, 10, 10, 10.0, 8)], "station_id int, r int, c int, h0 double, range_cells int")
    got = {(x["r"], x["c"]): x["least_height"] for x in sight.sweep(site, cells).collect()}
    disc = {(r, c) for r in range(21) for c in range(21) if 0 < (r - 10) ** 2 + (c - 10) ** 2 <= 64} - {(5, 5)}
    assert set(got) == disc
    assert all(h == 0 for (r, c), h in got.items() if c < 13)
    assert got[10, 16] == pytest.approx(10 + 20 / 3 * 6) and all(h > 0 for (r, c), h in got.items() if c > 13)
    flat = grid(spark, 21, 21, lambda r, c: 3)
    assert all(x["least_height"] == 0 for x in sight.sweep(site, flat).collect())


def test_on_axes_the_sweep_equals_rays_to_each_cell(spark, small):
    swept = {(x["station_id"], x["r"], x["c"]): x["least_height"] for x in catalog.QUERIES["swept_heights"](spark, small).collect()}
    rays = {(x["station_id"], x["r"], x["c"]): x["least_height"] for x in catalog.QUERIES["min_visible_height"](spark, small).collect()}
    sites = {s["station_id"]: (s["r"], s["c"]) for s in fixtures.stations(spark, small).collect()}
    both = [k for k in swept if k[1] == sites[k[0]][0] or k[2] == sites[k[0]][1]]
    assert len(both) > 50 and all(swept[k] == pytest.approx(rays[k], abs=1e-5) for k in both)
    assert set(swept) == {k for k in rays if k[1:] != sites[k[0]]}


def test_reads_of_tiles_are_pruned(spark, tmp_path):
    cells = grid(spark, 60, 60, lambda r, c: 100 * r + c)
    path = str(tmp_path / "tiles")
    tiles.write_tiles(cells, path, side=8)
    window = tiles.read_window(spark, path, 10, 12, 30, 31, side=8)
    assert sorted(r["z"] for r in window.collect()) == [100 * r + c for r in (10, 11, 12) for c in (30, 31)]
    assert "PartitionFilters: [isnotnull(tile_r" in window._jdf.queryExecution().toString()
    lines = spark.createDataFrame([(1, 5, 5, 5, 5), (2, 0, 59, 59, 0), (3, 50, 10, 52, 40)], "id int, r0 int, c0 int, r1 int, c1 int")
    near = tiles.along_lines(spark, path, lines, 2.0, side=8)
    assert "dynamicpruning" in near._jdf.queryExecution().toString()
    want = set()
    for k, r0, c0, r1, c1 in [(1, 5, 5, 5, 5), (2, 0, 59, 59, 0), (3, 50, 10, 52, 40)]:
        size = (r1 - r0) ** 2 + (c1 - c0) ** 2
        for r in range(60):
            for c in range(60):
                t = min(1, max(0, ((r - r0) * (r1 - r0) + (c - c0) * (c1 - c0)) / size)) if size else 0
                if (r - r0 - t * (r1 - r0)) ** 2 + (c - c0 - t * (c1 - c0)) ** 2 <= 4:
                    want.add((k, r, c))
    assert {(x["id"], x["r"], x["c"]) for x in near.collect()} == want and near.count() == len(want)


def test_tables_of_a_loop_go_when_it_ends(spark):
    import os

    rounds = checkpoint.Rounds()
    first = rounds.keep(spark.range(5))
    old = first.inputFiles()[0].removeprefix("file://")
    second = rounds.keep(first.selectExpr("id + 1 AS id"))
    assert not os.path.exists(old) and second.agg(F.sum("id")).first()[0] == 15
    new = second.inputFiles()[0].removeprefix("file://")
    rounds.drop()
    assert not os.path.exists(new)
