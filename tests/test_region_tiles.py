"""Regions are joined inside tiles first, so that links grow with the borders of tiles and not with the runs."""

import random

import pytest

from orograph.operators import regions


def flooded(cells):
    """The first cell of the region of each cell (r, c): value."""
    first = {}
    for start in sorted(cells):
        todo = [start] if start not in first else []
        while todo:
            at = todo.pop()
            if at in first or cells[at] != cells[start]:
                continue
            first[at] = start
            r, c = at
            todo += [p for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if p in cells]
    return first


@pytest.mark.parametrize("height, block", [(1, 1), (3, 4), (512, 256)])
def test_regions_are_the_same_whatever_the_tiles(spark, monkeypatch, height, block):
    monkeypatch.setattr(regions, "HEIGHT", height)
    monkeypatch.setattr(regions, "BLOCK", block)
    draw = random.Random(height)
    cells = {(r, c): v for r in range(-4, 18) for c in range(-5, 21) if (v := draw.choice("aaab.")) != "."}
    got = regions.labelled(spark.createDataFrame([(*at, v) for at, v in cells.items()], "r int, c int, value string")).collect()
    assert {(x["r"], x["c"]): x["region"] for x in got} == {at: r * 2**31 + c for at, (r, c) in flooded(cells).items()}


def test_a_run_over_several_blocks_is_one_row(spark, monkeypatch):
    monkeypatch.setattr(regions, "BLOCK", 4)
    low = 2**31  # a run's number is its row times this, and its first column
    runs = {(1, 0, 2, 13): 2, (1, 1, 13, 15): 2, (1, 1, 0, 0): low, (1, 2, 0, 3): low, (2, 1, 1, 12): low + 1, (None, 3, 0, 1): 3 * low, (None, 4, 0, 1): 4 * low}
    got = regions.components(spark.createDataFrame(list(runs), "value int, r int, c0 int, c1 int")).collect()
    assert {tuple(x) for x in got} == {(*run, region) for run, region in runs.items()} and len(got) == len(runs)


def test_only_borders_of_tiles_are_linked(spark, monkeypatch):
    asked = []
    plain = regions.graph.components
    monkeypatch.setattr(regions.graph, "components", lambda links: (asked.append(links.count()), plain(links))[1])
    cells = spark.range(40 * 700).selectExpr("cast(id div 40 as int) as r", "cast(id % 40 as int) as c", "1 as value").where("c % 2 = 0 or r % 100 = 0")
    found = regions.labelled(cells)
    assert found.select("region").distinct().count() == 1
    assert asked == [20]  # the columns that cross row 512, of some 14,000 links of runs
