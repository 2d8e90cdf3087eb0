"""Centroid clustering by Lloyd's rounds over weighted distinct vectors, in exact integers.

Each component x becomes the integer floor(``scale`` * x). Equal quantised
vectors are folded to one with a multiplicity before any round, rounds run over
the distinct vectors with weighted sums, and the assignments are joined back to
the vec_ids at the end. All sums are of integers, so neither the order of rows
nor the number of tasks nor a repeated task changes a bit of the result.

Scale: a round reads the distinct vectors once and shuffles ``k`` times
``dims`` sums a task; only those sums, added up, come to the driver. In the join
at the end, vectors with more than a ``HOT``-th of all rows (at most ``HOT``
vectors, whatever the table) meet their rows by a broadcast, the others by a
shuffle, so that a very common vector is no one task's work.

Cases: vectors that are null, of another length than ``dims``, or hold a null or
a component that is not finite take no part. A null vec_id clusters like any
other but is never a first centroid. Repeated rows are repeated vectors and give
repeated result rows. With fewer than ``k`` vectors (with an id) there are so
many centroids; without any the result is empty. First centroids may be equal;
then the smaller number takes the ties and the others stay where they are.
Quantised components are held within plus and minus ``LARGEST``, so that no sum
leaves 64 bits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import durable

LARGEST = 2**24
HOT = 1000


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and the quantised vector q of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    held = lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * scale))
    rows = vectors.where((F.size(x) == dims) & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(held(v)).cast("int")).alias("q"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) and its squared distance, exactly."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # Products of doubles are exact as long as their sums stay below 2**53.
    kind = np.float64 if largest * largest * vectors.shape[1] < 2**52 else np.int64
    products = vectors.astype(kind) @ centroids.astype(kind).T
    lengths = (centroids * centroids).sum(axis=1)
    apart = lengths[None, :] - 2 * products.astype(np.int64)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(best)), best] + (vectors * vectors).sum(axis=1)


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """For distinct vectors (q, weight): per centroid number the weight and the weighted sum of each component."""
    k, dims = centroids.shape

    def run(batches):
        import pyarrow as pa

        total, weights = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q, w = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            best, _ = nearest(q, centroids)
            np.add.at(total, best, q * w[:, None])
            np.add.at(weights, best, w)
        full = np.flatnonzero(weights)
        cols = [pa.array(np.repeat(full, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims), len(full)).astype(np.int32))]
        cols.append(pa.array(np.column_stack([weights[full], total[full]]).reshape(-1)))
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "place", "s"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in their order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.where("vec_id is not null").select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()
    return np.array([r["q"] for r in drawn], np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of what is nearest to each; empty ones stay."""
    found = distinct.mapInArrow(_sums(centroids), "cluster int, place int, s long").groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect()
    out, held = centroids.copy(), {(r["cluster"], r["place"]): r["s"] for r in found}
    for c, place in held:
        if place >= 0:
            out[c, place] = held[c, place] // held[c, -1]
    return out


def _assigned(centroids: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best, away = nearest(_matrix(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(away)], names=["q", "weight", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = durable(quantised(vectors, dims, scale))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    distinct = durable(rows.groupBy("q").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    placed = durable(distinct.mapInArrow(_assigned(centroids), "q array<int>, weight long, cluster int, distance long"))
    totals = placed.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("distance")).alias("s"), F.sum("weight").alias("n")).collect()  # k rows
    whole, many = sum(r["s"] for r in totals), sum(r["n"] for r in totals)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    per = spark.createDataFrame([(r["cluster"], r["s"], whole, digest(r["cluster"])) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = placed.where(F.col("weight") > many / HOT).select("q", "cluster", "distance")
    common = rows.join(F.broadcast(hot), "q")  # fewer than HOT vectors, by their weight
    others = rows.join(F.broadcast(hot.select("q")), "q", "left_anti").join(placed.where(F.col("weight") <= many / HOT).select("q", "cluster", "distance"), "q")
    joined = common.unionByName(others).select("vec_id", "cluster", "distance")
    return joined.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _round(n: int) -> str:
    """CTEs of one round: nearest centroids under c{n}, and the next ones."""
    return f"""
d{n} AS (SELECT v, k, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c{n} c USING (i) GROUP BY v, k),
a{n} AS (SELECT v, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY v),
m{n} AS (SELECT k, i, (CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END)::BIGINT AS x FROM q JOIN a{n} USING (v) GROUP BY k, i),
c{n + 1} AS (SELECT k, i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (k, i))"""


ORACLE = (
    """
WITH r AS (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT v, unnest(e) AS x, unnest(range(1, 65)) AS i FROM r),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k FROM r WHERE vec_id IS NOT NULL),
c0 AS (SELECT k, i, x FROM q JOIN s USING (v) WHERE k < 16),"""
    + ",".join(_round(n) for n in range(3))
    + """,
d3 AS (SELECT v, k, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c3 c USING (i) GROUP BY v, k),
a3 AS (SELECT v, arg_min(k, (d, k)) AS k, min(d) AS d FROM d3 GROUP BY v),
h AS (SELECT k, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN r USING (v) JOIN h USING (k)
"""
)
