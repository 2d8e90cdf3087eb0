"""Closed rings around regions of a grid, as polygons with holes.

A cell has four sides, directed so that the cell lies to the right; sides that
two cells of a region share are none. The others join into rings by
a successor at each corner: the sharpest turn to the right, which keeps cells
that touch only at a corner apart. Shells go round with a positive area and
holes with a negative one, and as a region is 4-connected it has one shell, to
which its holes belong.

A task has the cells of a square tile and those around it, so that every side and
its successor is told there. Order along a ring is list ranking: the task follows
the sides inside its tile, which leaves one row for each stretch of a ring through a tile, and the
stretches are ranked by pointers that double each round. So no ring, however
long, passes through one task, and rounds number the logarithm of the tiles it
crosses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators.checkpoint import Rounds, durable

TILE = 256
#: Per side of a cell (top, right, bottom, left; so east, south, west, north): where it begins.
SIDES = [(0, 0), (0, 1), (1, 1), (1, 0)]
_STEP_Y, _STEP_X = (0, 1, 0, -1), (1, 0, -1, 0)


def _picked(values: tuple[int, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _stretches(ids, nexts):
    """For sides of a tile and those that come next: the first side of their stretch inside the tile, and their place on it."""
    order = np.argsort(ids)
    at = np.searchsorted(ids, nexts, sorter=order)
    at = np.where(at < len(ids), order[np.minimum(at, len(ids) - 1)], 0)
    inside = ids[at] == nexts
    led = np.zeros(len(ids), bool)
    led[at[inside]] = True
    head, place = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
    to, goes = at.tolist(), inside.tolist()

    def walk(i):
        first, n = i, 0
        while place[i] < 0:
            head[i], place[i] = ids[first], n
            n += 1
            if not goes[i]:
                return
            i = to[i]

    for i in np.flatnonzero(~led).tolist():
        walk(i)
    for i in order.tolist():  # whole rings inside the tile, from their least side
        if place[i] < 0:
            walk(i)
    return head, place


def followed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Directed boundary sides of cells (keys, r, c) and what comes next: keys, id, way, next, next_way, y, x, head and place.

    ``way`` is 0 to 3 for east, south, west, north, and ``id`` orders sides by the
    row, column and side of their cell; ``head`` is the first side of their
    stretch inside a tile and ``place`` theirs on it. A task has the cells of one
    tile and those around it.
    """
    size = TILE
    reach = lambda n: F.explode(F.sequence(F.floor((F.col(n) - 1) / size), F.floor((F.col(n) + 1) / size)))
    sent = cells.select(*keys, "r", "c").withColumn("ty", reach("r")).withColumn("tx", reach("c"))
    typed = lambda n, t: f"`{n}` {t}"
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    told = {"id": "long", "way": "int", "next": "long", "next_way": "int", "y": kinds["r"], "x": kinds["c"], "head": "long", "place": "long"}

    def trace(tile: tuple, some: pa.Table) -> pa.Table:
        top, left = (k.as_py() * size - 1 for k in tile)
        r, c = (some[n].to_numpy().astype(np.int64) for n in ("r", "c"))
        code = np.zeros(some.num_rows, np.int64)
        for k in keys:
            each = some[k].combine_chunks().dictionary_encode()
            at = each.indices.fill_null(len(each.dictionary)).to_numpy(zero_copy_only=False)
            code = np.unique(code * (len(each.dictionary) + 1) + at, return_inverse=True)[1]
        label, y, x = np.full((size + 2, size + 2), -1), r - top, c - left
        label[y, x] = code
        mine = np.flatnonzero((y > 0) & (y <= size) & (x > 0) & (x <= size))
        found = []
        for way in range(4):
            (dy, dx), (ly, lx) = ((_STEP_Y[w % 4], _STEP_X[w % 4]) for w in (way, way + 3))  # ahead and to the left
            side = mine[label[y[mine] + ly, x[mine] + lx] != code[mine]]
            same = lambda a, b: label[y[side] + a, x[side] + b] == code[side]  # noqa: B023, E731
            ahead, across = same(dy, dx), same(dy + ly, dx + lx)
            # Right around the cell itself if none of the region lies ahead, straight along that one, or left along the one across.
            turned = np.where(ahead, np.where(across, way + 3, way), way + 1) % 4
            to_r, to_c = r[side] + ahead * (dy + across * ly), c[side] + ahead * (dx + across * lx)
            number = lambda a, b, w: (a * 2**31 + b) * 4 + w
            found.append((side, number(r[side], c[side], way), np.full(len(side), way), number(to_r, to_c, turned), turned, r[side] + SIDES[way][0], c[side] + SIDES[way][1]))
        side, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
        columns += _stretches(columns[0], columns[2])
        arrays = [pa.array(v.astype({"int": np.int32}.get(t, np.int64))) for v, t in zip(columns, told.values(), strict=True)]
        return pa.table([*some.select(keys).take(pa.array(side)).columns, *arrays], names=[*keys, *told])

    schema = ", ".join(typed(*x) for x in [*((k, kinds[k]) for k in keys), *told.items()])
    return sent.groupBy("ty", "tx").applyInArrow(trace, schema)


def _doubled(rows: DataFrame, to: str, take: dict[str, Column]) -> DataFrame:
    """Rows (head, ``to``, values) joined with the row they point to; ``take`` makes the new values from both."""
    ahead = rows.select(F.col("head").alias(to), *(F.col(c).alias(f"far_{c}") for c in rows.columns if c != "head"))
    return rows.join(ahead, to, "left").select("head", F.col(f"far_{to}").alias(to), *(v.alias(n) for n, v in take.items()))


def ranked(placed: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Sides (as ``followed`` gives them) with ``ring``, the least side of their ring, ``n``, its length, and ``nth``, their place from that side on."""
    chains = placed.groupBy("head").agg(F.count("*").alias("length"), F.max_by("next", "place").alias("exit"), F.min("id").alias("least"), F.min_by("place", "id").alias("least_at"))
    chains = durable(chains)
    within = chains.where("exit = head").select("head", F.col("least").alias("ring"), F.col("length").alias("n"), (-F.col("least_at")).alias("start"))
    chains = chains.where("exit <> head")
    labels = chains.select("head", F.col("exit").alias("to"), F.col("least").alias("ring"))
    told, run = Rounds(), Rounds()
    for _ in range(max_rounds):
        new = told.keep(_doubled(labels, "to", {"ring": F.least("ring", "far_ring"), "changed": F.col("far_ring") < F.col("ring")}))
        labels = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    else:
        raise RuntimeError("rings did not settle")
    of = chains.join(labels.select("head", "ring"), "head")
    # The stretch with the least side comes first; what is left to run from each stretch to the end, again by doubling.
    first = of.where("ring = least").select(F.col("head").alias("exit"), F.lit(True).alias("last"))
    ends = durable(of.join(first, "exit", "left"))
    told.drop()
    left = ends.select("head", F.when(F.col("last").isNull(), F.col("exit")).alias("to"), F.col("length").alias("left"))
    for _ in range(max_rounds):
        if left.where("to is not null").isEmpty():
            break
        left = run.keep(_doubled(left, "to", {"left": F.col("left") + F.coalesce("far_left", F.lit(0))}))
    else:
        raise RuntimeError("rings did not end")
    whole = ends.where("ring = least").join(left, "head").select("ring", F.col("left").alias("n"), "least_at")
    starts = ends.select("head", "ring").join(left, "head").join(whole, "ring").select("head", "ring", "n", (F.col("n") - F.col("left") - F.col("least_at")).alias("start"))
    starts = durable(starts.union(within))
    run.drop()
    return placed.join(starts, "head").withColumn("nth", F.pmod(F.col("start") + F.col("place"), F.col("n"))).drop("head", "place", "start")


def rings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary sides of regions of cells (keys, r, c), in order: keys, id, way, next, next_way, y, x, ring, n and nth."""
    return ranked(durable(followed(cells, keys)))


def summary(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per ring its length, corners, area (negative for a hole) and ``hole``."""
    area = F.sum(F.when(F.col("way") == 1, F.col("x")).when(F.col("way") == 3, -F.col("x")).otherwise(0).cast("long"))
    out = edges.groupBy(*keys, "ring").agg(F.count("*").alias("length"), F.count_if(F.col("way") != F.col("next_way")).alias("corners"), area.alias("area"))
    return out.withColumn("hole", F.col("area") < 0)


def corners(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The corners (keys, ring, n, nth, y, x) of each ring in order of ``nth``: where a side ends and the next one turns."""
    turned = edges.where("way <> next_way")
    return turned.select(*keys, "ring", "n", F.pmod(F.col("nth") + 1, F.col("n")).alias("nth"), (F.col("y") + _picked(_STEP_Y, F.col("way"))).alias("y"), (F.col("x") + _picked(_STEP_X, F.col("way"))).alias("x"))


def _kept(y: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Of the points between ``a`` and ``b`` of each stretch, those that a line within the tolerance of all must keep, by halving at the farthest.

    All stretches are halved at once, so rounds number the halvings of the most winding one.
    """
    keep = np.zeros(len(y), bool)
    while len(a):
        a, b = a[b - a > 1], b[b - a > 1]
        many = b - a - 1
        whose, opens = np.repeat(np.arange(len(a)), many), np.cumsum(many) - many
        at = np.arange(len(whose)) - opens[whose] + a[whose] + 1
        dy, dx = y[b] - y[a], x[b] - x[a]
        size = dy * dy + dx * dx
        dy, dx, size, py, px = dy[whose], dx[whose], size[whose], y[at] - y[a][whose], x[at] - x[a][whose]
        t = np.clip(np.divide(py * dy + px * dx, size, out=np.zeros(len(at)), where=size > 0), 0, 1)
        away = np.hypot(py - t * dy, px - t * dx)
        most = np.maximum.reduceat(away, opens) if len(a) else away
        far = np.flatnonzero(away == most[whose])
        far = at[far[np.searchsorted(whose[far], np.arange(len(a)))]]  # the first of equals
        cut = most > tolerance
        keep[far[cut]] = True
        a, b = np.concatenate([a[cut], far[cut]]), np.concatenate([far[cut], b[cut]])
    return keep


def _thinned(tolerance: float, columns: list[str]):
    """Corners of the stretches of a task that stay when each is thinned; see ``simplified``."""

    def run(some: pa.Table) -> pa.Table:
        some = some.sort_by([(n, "ascending") for n in ("ring", "block", "nth")])
        ring, block = (some[n].to_numpy() for n in ("ring", "block"))
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(ring) != 0) | (np.diff(block) != 0)]))
        nth = np.append(opens[1:], len(ring)) - 1
        # Each stretch is followed by the corner that opens the next.
        y, x = (np.insert(some[n].to_numpy().astype(float), nth + 1, some[f"end_{n}"].to_numpy()[nth]) for n in ("y", "x"))
        first = opens + np.arange(len(opens))
        last = nth + np.arange(len(opens)) + 1
        keep = _kept(y, x, first, last, tolerance)
        keep[first] = True
        return some.select(columns).take(pa.array(np.flatnonzero(np.delete(keep, last))))

    return run


def simplified(points: DataFrame, keys: list[str], tolerance: float, block: int = 4096) -> DataFrame:
    """Corners (as ``corners`` gives them) that stay when a ring may move by ``tolerance``.

    A ring is cut into stretches of ``block`` sides whose first corners stay, and
    each is thinned alone, with the others of its task at once; a long ring is no
    one task's work. No corner left out is farther than the tolerance from the line that replaces it.
    """
    blocks = points.withColumn("block", F.floor(F.col("nth") / block))
    opening = blocks.groupBy("ring", "block").agg(F.min_by(F.struct("y", "x"), "nth").alias("p"))
    order = Window.partitionBy("ring").orderBy("block")  # a row for each stretch
    first = F.first("p").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    opening = opening.select("ring", "block", F.coalesce(F.lead("p").over(order), first).alias("p")).select("ring", "block", F.col("p.y").alias("end_y"), F.col("p.x").alias("end_x"))
    joined = durable(blocks.join(opening, ["ring", "block"]))
    tasks = joined.count() // 50_000 + 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return joined.groupBy(F.pmod(F.xxhash64("ring", "block"), F.lit(tasks))).applyInArrow(_thinned(tolerance, points.columns), fields)
