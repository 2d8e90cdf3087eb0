"""Closed meshes and contact lines on small grids."""

import random

import pytest

from orograph.operators import mesh


def points(spark, rows, columns="r int, c int"):
    return spark.createDataFrame(rows, columns)


def test_dense_numbers_follow_the_order(spark):
    draw = random.Random(1)
    rows = draw.sample([(a, b) for a in range(40) for b in range(30)], 700)
    got = mesh.numbered(points(spark, rows, "a int, b int"), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(rows)
    assert sorted(r["id"] for r in got) == list(range(700))


@pytest.mark.parametrize("seed", range(2))
def test_solids_are_closed(spark, seed):
    draw = random.Random(seed)
    cells = [(r, c) for r in range(14) for c in range(14) if draw.random() < 0.85]
    vertices, triangles = mesh.solid(points(spark, cells))
    at = {v["id"]: (v["r"], v["c"], v["level"]) for v in vertices.collect()}
    faces = [tuple(t) for t in triangles.collect()]
    squares = {(r, c) for r, c in cells if {(r, c + 1), (r + 1, c), (r + 1, c + 1)} <= set(cells)}
    assert sorted(at) == list(range(len(at))) and len({tuple(sorted(f)) for f in faces}) == len(faces)
    found = mesh.edges(triangles).collect()
    assert all(e["up"] == e["down"] >= 1 for e in found)
    # The volume inside, by the divergence theorem: a unit for each square.
    volume = 0
    for a, b, c in faces:
        (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = at[a], at[b], at[c]
        volume += x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2)
    assert abs(volume / 6) == pytest.approx(len(squares)) and volume > 0


def test_one_square_is_a_box(spark):
    vertices, triangles = mesh.solid(points(spark, [(0, 0), (0, 1), (1, 0), (1, 1)]))
    found = mesh.edges(triangles).collect()
    assert vertices.count() == 8 and triangles.count() == 12 and len(found) == 18 and all(e["up"] == e["down"] == 1 for e in found)
    assert mesh.solid(points(spark, [(0, 0), (0, 1), (5, 5)]))[1].isEmpty()


def test_contact_of_a_slope_with_a_plain(spark):
    rows = [(1, r, c, 2.5 - c) for r in range(4) for c in range(6)]
    got = mesh.contact(points(spark, rows, "k int, r int, c int, d double"), ["k"]).collect()
    assert len(got) == 6 and all(s["x0"] == s["x1"] == 2.5 for s in got)
    assert sorted(abs(s["y0"] - s["y1"]) for s in got) == pytest.approx([0.5] * 6)
    assert mesh.contact(points(spark, [(1, r, c, 1.0) for r in range(3) for c in range(3)], "k int, r int, c int, d double"), ["k"]).isEmpty()
