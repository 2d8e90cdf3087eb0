"""Rings, filled holes, overviews, resampling, projections and planes on small literal grids."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph import catalog
from orograph.functions import scalars as S
from orograph.operators import components, pyramid, regions, resample, rings
from orograph.plans import polygons, surfaces

CELLS = "r int, c int, z double, valid boolean"


def painted(spark, lines):
    rows = [(r, c, int(v)) for r, line in enumerate(lines) for c, v in enumerate(line) if v != "."]
    return regions.labelled(spark.createDataFrame(rows, "r int, c int, value int"))


def ordered(edges):
    """Corners of each ring in order, with its summary."""
    points = defaultdict(list)
    for p in sorted(rings.corners(edges, polygons.KEYS).collect(), key=lambda p: p["nth"]):
        points[p["ring"]].append((p["x"], p["y"]))
    return {s["ring"]: (s, points[s["ring"]]) for s in rings.summary(edges, polygons.KEYS).collect()}


def shoelace(points):
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True)) / 2


def closed(points):
    return all((x0 == x1) != (y0 == y1) for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True))


def test_rings_of_a_region_with_holes_and_touching_corners(spark):
    cells = painted(spark, ["111111", "1.11.1", "11.111", "111111", "....2.", ".3..22"])
    found = ordered(rings.rings(cells, polygons.KEYS))
    by_value = defaultdict(list)
    for summary, points in found.values():
        assert closed(points) and shoelace(points) == summary["area"] and len(points) == summary["corners"]
        assert summary["length"] == sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(points, points[1:] + points[:1], strict=True))
        by_value[summary["value"]].append(summary["area"])
    # Holes that touch at a corner are one hole to the 4-connected cells around them.
    assert sorted(by_value[1]) == [-2, -1, 24] and by_value[2] == [3] and by_value[3] == [1]


def test_cells_touching_at_a_corner_keep_their_own_rings(spark):
    found = ordered(rings.rings(painted(spark, ["1.", ".1"]), polygons.KEYS))
    assert sorted(s["area"] for s, _ in found.values()) == [1, 1] and all(len(p) == 4 for _, p in found.values())


def snake(n):
    """One way of one cell's width that fills a square, row after row."""
    ends = ["." * (n - 1) + "1", "1" + "." * (n - 1)]
    return ["1" * n if r % 2 == 0 else ends[r // 2 % 2] for r in range(n)]


def test_a_ring_through_many_tiles_is_one_ring_in_order(spark, monkeypatch):
    monkeypatch.setattr(rings, "TILE", 5)
    lines = snake(31)
    (summary, points), = ordered(rings.rings(painted(spark, lines), polygons.KEYS)).values()
    assert summary["area"] == sum(x.count("1") for x in lines) == shoelace(points) and closed(points)
    assert summary["length"] == 2 * summary["area"] + 2  # a way of one cell's width


@pytest.mark.parametrize("seed", range(3))
def test_random_rings_close_around_their_cells(spark, monkeypatch, seed):
    monkeypatch.setattr(rings, "TILE", 7)
    draw = random.Random(seed)
    lines = ["".join(draw.choice("1112.") for _ in range(40)) for _ in range(25)]
    found = ordered(rings.rings(painted(spark, lines), polygons.KEYS))
    shells, areas = defaultdict(int), defaultdict(int)
    for summary, points in found.values():
        assert closed(points) and shoelace(points) == summary["area"]
        areas[summary["region"]] += summary["area"]
        shells[summary["region"]] += not summary["hole"]
    cells = {r["region"]: r["n"] for r in painted(spark, lines).groupBy("region").agg(F.count("*").alias("n")).collect()}
    assert dict(areas) == cells and set(shells.values()) == {1}


def away(p, a, b):
    p, a, b = (np.array(v, float) for v in (p, a, b))
    size = (b - a) @ (b - a)
    t = min(1, max(0, (p - a) @ (b - a) / size)) if size else 0
    return float(np.hypot(*(p - a - t * (b - a))))


@pytest.mark.parametrize("block", [4096, 40])
def test_simplified_rings_stay_within_their_tolerance(spark, block):
    draw = random.Random(9)
    lines = ["".join(draw.choice("1111.") for _ in range(40)) for _ in range(30)]
    corners = rings.corners(rings.rings(painted(spark, lines), polygons.KEYS), polygons.KEYS)
    whole, kept = defaultdict(list), defaultdict(set)
    for p in corners.collect():
        whole[p["ring"]].append((p["nth"], (p["x"], p["y"])))
    thin = rings.simplified(corners, polygons.KEYS, 1.5, block).collect()
    for p in thin:
        kept[p["ring"]].add(p["nth"])
    assert kept.keys() == whole.keys() and len(thin) < 0.7 * corners.count()
    for ring, points in whole.items():
        points.sort()
        assert points[0][0] in kept[ring]
        line = [*points, (points[0][0] + 10**9, points[0][1])]
        last = 0
        for k in range(1, len(line)):
            if k + 1 == len(line) or line[k][0] in kept[ring]:
                assert all(away(p, line[last][1], line[k][1]) <= 1.5 + 1e-9 for _, p in line[last + 1 : k])
                last = k


def test_a_polygon_names_its_shell_first(spark):
    feature = polygons.polygons(rings.rings(painted(spark, ["222", "2.2", "222"]), polygons.KEYS)).first()
    assert feature["rings"] == 2
    assert feature["feature"] == '{"type":"Feature","properties":{"coverage_count":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[3,0],[3,3],[0,3],[0,0]],[[2,1],[1,1],[1,2],[2,2],[2,1]]]}}'


def test_nothing_has_no_rings(spark):
    assert rings.rings(regions.labelled(spark.createDataFrame([], "r int, c int, value int")), polygons.KEYS).isEmpty()


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_of_chains_stars_and_repeats(spark, few):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 300)] + [(500, 500), (7, 3), (7, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 300)}


def grid(spark, rows, cols, height, valid=lambda r, c: True):
    return spark.createDataFrame([(r, c, float(height(r, c)), valid(r, c)) for r in range(rows) for c in range(cols)], CELLS)


def test_holes_of_any_size_are_filled_from_near(spark):
    cells = grid(spark, 48, 48, lambda r, c: 100.0, lambda r, c: not (2 <= r < 46 and 2 <= c < 46))
    got = pyramid.filled(cells).collect()
    assert len(got) == 44 * 44 and all(r["z"] == pytest.approx(100) for r in got)
    two = grid(spark, 8, 64, lambda r, c: 0.0 if c == 0 else 50.0, lambda r, c: c in (0, 63))
    z = {(r["r"], r["c"]): r["z"] for r in pyramid.filled(two).collect()}
    assert z[4, 1] == 0 and z[4, 62] == 50 and all(-1e-9 <= v <= 50 + 1e-9 for v in z.values())
    lone = pyramid.filled(grid(spark, 3, 3, lambda r, c: 7.0, lambda r, c: (r, c) == (2, 2))).collect()
    assert len(lone) == 8 and all(r["z"] == pytest.approx(7) for r in lone)
    assert all(r["z"] is None for r in pyramid.filled(grid(spark, 2, 2, lambda r, c: 1.0, lambda r, c: False)).collect())
    assert pyramid.filled(grid(spark, 2, 2, lambda r, c: 1.0)).isEmpty()


def test_every_level_equals_one_from_the_base_cells(spark):
    draw = random.Random(4)
    heights = {(r, c): (draw.random() * 100, draw.random() > 0.2) for r in range(13) for c in range(21)}
    cells = grid(spark, 13, 21, lambda r, c: heights[r, c][0], lambda r, c: heights[r, c][1])
    found = pyramid.levels(cells)
    assert len(found) == 6 and found[-1].count() == 1
    for k, level in enumerate(found):
        want = defaultdict(list)
        for (r, c), (z, ok) in heights.items():
            if ok:
                want[r >> k, c >> k].append(z)
        got = {(x["tr"], x["tc"]): x for x in level.collect()}
        assert got.keys() == want.keys()
        for at, zs in want.items():
            assert got[at]["n"] == len(zs) and got[at]["total"] == pytest.approx(sum(zs)) and (got[at]["low"], got[at]["high"]) == (min(zs), max(zs))


def test_bilinear_over_valid_cells_only(spark):
    cells = grid(spark, 4, 4, lambda r, c: 10 * r + c, lambda r, c: (r, c) != (1, 1))
    places = [(0, 0.0, 0.0), (1, 0.5, 0.5), (2, 2.5, 2.25), (3, 1.0, 1.0), (4, 0.75, 0.75), (5, 3.0, 3.0), (6, 3.5, 3.5), (7, -0.4, 0.0), (8, 9.0, 9.0)]
    targets = spark.createDataFrame(places, "k int, y double, x double")
    value = {need: {r["k"]: r["z"] for r in resample.bilinear(targets, cells, ["k"], need).collect()} for need in ("any", "nearest", "all")}
    assert value["any"] == pytest.approx({0: 0, 1: (0 + 1 + 10) / 3, 2: 27.25, 4: (0 * 0.0625 + 1 * 0.1875 + 10 * 0.1875) / 0.4375, 5: 33, 6: 33, 7: 0})
    assert set(value["nearest"]) == {0, 2, 5, 7} and set(value["all"]) == {0, 2, 5}


def test_a_budget_holds_after_enough_coarsening(spark):
    rows = spark.createDataFrame([(100.0, 100.0, 1.0), (3.0, 7000.0, 1.0), (10.0, 10.0, 2.0)], "h double, w double, s double")
    many = F.ceil(F.col("h") / F.col("s")) * F.ceil(F.col("w") / F.col("s"))
    for r in rows.withColumn("step", resample.within(many, F.col("h"), F.col("w"), F.col("s"), 400)).collect():
        assert math.ceil(r["h"] / r["step"]) * math.ceil(r["w"] / r["step"]) <= 400 and r["step"] >= r["s"]
    assert r["step"] == 2


def test_projection_there_and_back_within_a_micrometre(spark):
    places = [(lon / 4, lat / 2) for lon in range(4 * 78, 4 * 84 + 1, 3) for lat in range(-160, 161, 7)]
    there = S.to_utm(F.col("lon"), F.col("lat"), 81.0)
    rows = spark.createDataFrame(places, "lon double, lat double").withColumns({"e": there[0], "n": there[1]})
    back = S.from_utm(F.col("e"), F.col("n"), 81.0)
    again = rows.withColumns({"lon2": back[0], "lat2": back[1]})
    once = S.to_utm(F.col("lon2"), F.col("lat2"), 81.0)
    for r in again.withColumns({"e2": once[0], "n2": once[1]}).collect():
        assert abs(r["e"] - r["e2"]) < 1e-6 and abs(r["n"] - r["n2"]) < 1e-6 and abs(r["lon"] - r["lon2"]) < 1e-10 and abs(r["lat"] - r["lat2"]) < 1e-10
    # A published point: 9 degrees east, 48 north lies on the central meridian of zone 32.
    e, n = spark.range(1).select(*S.to_utm(F.lit(9.0), F.lit(48.0), 9.0)).first()
    assert e == pytest.approx(500000, abs=1e-6) and n == pytest.approx(5316300.2, abs=0.1)


def test_planes_and_their_residuals(spark):
    draw = np.random.default_rng(1)
    points = [(1, float(x + 5e6), float(y - 3e6), float(2 * x - y + 7)) for x in range(5) for y in range(4)]
    rough = [(2, float(x), float(y), float(3 * x + y + e)) for (x, y), e in zip(((x, y) for x in range(6) for y in range(6)), draw.normal(0, 1, 36), strict=True)]
    got = {r["k"]: r for r in surfaces.planes(spark.createDataFrame([*points, *rough, (3, 1.0, 1.0, 1.0)], "k int, x double, y double, z double"), ["k"]).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["a"], got[1]["b"]) == pytest.approx((2, -1)) and got[1]["rmse"] == pytest.approx(0, abs=1e-6) and got[1]["slope_deg"] == pytest.approx(math.degrees(math.atan(math.sqrt(5))))
    design = np.array([(x, y, 1) for _, x, y, _ in rough])
    fit, *_ = np.linalg.lstsq(design, np.array([z for *_, z in rough]), rcond=None)
    left = np.array([z for *_, z in rough]) - design @ fit
    assert got[2]["a"] == pytest.approx(fit[0]) and got[2]["rmse"] == pytest.approx(math.sqrt((left**2).mean())) and got[2]["largest"] == pytest.approx(abs(left).max())


def test_a_registered_simplification_keeps_every_ring(spark, small):
    thin = catalog.QUERIES["simplified_rings"](spark, small)
    assert thin.select("ring").distinct().count() == catalog.QUERIES["region_rings"](spark, small).count()
