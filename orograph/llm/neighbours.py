"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves and each half is quantised by its own k-means, so
``cells`` x ``cells`` lists of vectors come from two small codebooks. A query
walks pairs of centroids in the order of their summed squared distances, with a
heap, until the lists passed hold its share of all vectors; what they hold is
compared exactly, in double precision.

Scale: the codebooks are fitted on a bounded sample; every vector is indexed.
There are more centroids in a larger table, and a query's share is told from the
sample as what the wanted recall needs: little where vectors are clustered, more
than half where they are not. Equal vectors are one entry with its smallest ids
(as many as a result can need), so a group of copies is no hot list, and equal
queries are searched once. Lists are dealt to parts of about ``part_rows``
entries and queries to blocks of about ``block_rows`` whose first centroids are
near in number; a part goes only to the blocks that open a list of it, so that
with small shares an entry goes to few. A task holds one part and one block and
returns at most k + 1 rows a query. The driver sees the sample and one count per
pair of centroids.

Cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part, as queries or candidates. Ties in
distance go to the smaller vec_id. With fewer than k candidates all are
returned. Rows with a null vec_id take no part. Repeated rows of one vec_id count
as one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import durable


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    good = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (length[0]["n"] if length else 0)).dropDuplicates(["vec_id", "v"])


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of a bounded sample."""
    draw = np.random.default_rng(seed)
    centres = points[np.sort(draw.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        for c in range(len(centres)):
            mine = points[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(points, centres).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until their lists hold ``wanted`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, got = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = (int(a[i]), int(b[j]))
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (first[a[i2]] + second[b[j2]], i2, j2))
    return out


def share_for(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, k: int, recall: float, asked: int = 256) -> float:
    """The share of all vectors whose lists must be passed so that ``recall`` of the nearest are among them.

    Told from the sample: the nearest of its first vectors in the rest of it, and
    where on each walk their lists come. In the whole table neighbours are nearer,
    so their lists come earlier.
    """
    half = books[0].shape[1]
    of = np.stack([nearest(part, book) if book.shape[1] else np.zeros(len(part), int) for part, book in zip((sample[:, :half], sample[:, half:]), books, strict=True)], axis=1)
    needed = []
    for i in range(min(asked, len(sample))):
        q = sample[i : i + 1]
        away = squared(q, sample)[0]
        away[i] = np.inf
        near = np.argsort(away, kind="stable")[: min(k, len(sample) - 1)]
        sums = squared(q[:, :half], books[0])[0][:, None] + squared(q[:, half:], books[1])[0][None]
        order = np.argsort(sums, axis=None, kind="stable")
        passed = np.empty(order.size)
        passed[order] = np.cumsum(held.reshape(-1)[order])
        needed += passed.reshape(held.shape)[of[near, 0], of[near, 1]].tolist()
    return float(np.quantile(needed, recall, method="higher")) / max(1, held.sum()) if needed else 1.0


def search(table: DataFrame, every: int = 100, k: int = 10, cells: int | None = None, share: float | None = None, recall: float = 0.95, sample_rows: int = 4096, part_rows: int = 20_000, block_rows: int = 8192) -> DataFrame:
    """The k nearest found of the vectors whose id is a multiple of ``every``: query_id, rank, vec_id, score.

    Without ``cells`` there are as many as an eighth of the root of the number of
    vectors (8 to 256). Without ``share`` it is what ``recall`` asks for on the sample.
    """
    rows = usable(table)
    # A result needs at most k + 1 ids of one vector (its own is left out).
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = durable(entries)
    queries = rows.where(F.col("vec_id") % every == 0)
    sample = np.array([r["v"] for r in entries.orderBy(F.xxhash64("v"), "ids").limit(sample_rows).collect()], float)
    if not len(sample):
        sample = np.ones((1, 2))
    cells = cells or int(np.clip(np.sqrt(entries.count()) / 8, 8, 256))
    half = -(-sample.shape[1] // 2)
    books = (k_means(sample[:, :half], cells), k_means(sample[:, half:], cells) if sample.shape[1] > half else np.zeros((1, 0)))

    def matrix(column) -> np.ndarray:
        return np.array(column.to_pylist(), float).reshape(len(column), -1)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            v = matrix(batch.column("v"))
            cols = [pa.array(nearest(part, book).astype(np.int32)) for part, book in zip((v[:, :half], v[:, half:]), books, strict=True)] if len(v) else [pa.array([], pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["v", "ids", "c1", "c2"])

    placed = durable(entries.mapInArrow(place, "v array<double>, ids array<long>, c1 int, c2 int"))
    held = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # at most cells x cells rows
        held[r["c1"], r["c2"]] = r["count"]
    salts = np.maximum(1, -(-held.sum(axis=1) // part_rows))
    share = share_for(sample, books, held, k, recall) if share is None else share
    wanted = max(20 * k, int(np.ceil(share * held.sum())))

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            v = matrix(batch.column("v"))
            out = {"q": [], "v": [], "own": [], "c1": [], "salt": [], "seconds": []}
            near = [squared(part, book) for part, book in zip((v[:, :half], v[:, half:]), books, strict=True)] if len(v) else []
            for i, q in enumerate(batch.column("q").to_pylist()):
                by: dict[int, list[int]] = {}
                for a, b in walk(near[0][i], near[1][i], held, wanted):
                    by.setdefault(a, []).append(b)
                own = int(near[0][i].argmin())
                for a, seconds in by.items():
                    for s in range(int(salts[a])):
                        for name, value in zip(out, (q, v[i], own, a, s, seconds), strict=True):
                            out[name].append(value)
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

    asked = durable(queries.groupBy("v").agg(F.min("vec_id").alias("q")))
    blocks = max(1, -(-asked.count() // block_rows))
    # Queries of one first centroid open much the same lists, so they are dealt to blocks by it.
    block = F.when(F.lit(blocks) == 1, F.lit(0)).otherwise(F.pmod(F.floor(F.col("own") * F.lit(blocks) / F.lit(len(books[0]))) + F.pmod(F.xxhash64("q"), F.greatest(F.lit(1), F.lit(blocks // len(books[0])))), F.lit(blocks))).cast("int")
    routed = asked.mapInArrow(route, "q long, v array<double>, own int, c1 int, salt int, seconds array<int>").withColumn("block", block).drop("own")
    most = F.element_at(F.array(*(F.lit(int(s)) for s in salts)), F.col("c1") + 1)
    if blocks > 1:
        routed = durable(routed)
        opened = routed.select("c1", "salt", F.col("block").alias("to")).distinct()
        dealt = placed.withColumn("salt", F.pmod(F.xxhash64("ids"), most).cast("int")).join(opened, ["c1", "salt"]).withColumnRenamed("to", "block")
    else:
        dealt = placed.withColumn("salt", F.pmod(F.xxhash64("ids"), most).cast("int")).withColumn("block", F.lit(0))

    def compare(mine, theirs):
        out = []
        if len(mine) and len(theirs):
            x = np.array(mine["v"].tolist(), float)
            least = np.array([i[0] for i in mine["ids"]])
            second = mine["c2"].to_numpy()
            for at in range(0, len(theirs), 128):
                part = theirs.iloc[at : at + 128]
                q = np.array(part["v"].tolist(), float)
                open_ = np.zeros((len(part), held.shape[1]), bool)
                for i, s in enumerate(part["seconds"]):
                    open_[i, s] = True
                d = np.where(open_[:, second], squared(q, x), np.inf)
                for i, name in enumerate(part["q"]):
                    # Rounding of the products can't move an entry past the margin.
                    bar = np.partition(d[i], k)[k] if len(x) > k + 1 else np.inf
                    near = np.flatnonzero((d[i] <= bar + 1e-9 * (1 + abs(bar))) & np.isfinite(d[i])) if np.isfinite(bar) else np.flatnonzero(np.isfinite(d[i]))
                    exact = np.sqrt(np.square(x[near] - q[i]).sum(axis=1))
                    for j in np.lexsort((least[near], exact))[: k + 1]:
                        out.append((name, exact[j], mine["ids"].iloc[near[j]]))
        return pd.DataFrame(out, columns=["q", "score", "ids"])

    pairs = dealt.groupBy("c1", "salt", "block").cogroup(routed.groupBy("c1", "salt", "block")).applyInPandas(compare, "q long, score double, ids array<long>")
    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    top = pairs.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("nth", best).where(F.col("nth") <= k + 1).drop("nth")
    named = queries.join(asked, "v").select(F.col("vec_id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.join(top, "q").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
