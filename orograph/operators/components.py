"""Connected components of a graph given as links, by star contraction.

Each round hangs every node on the smallest node it sees (large star), then
every node's smaller neighbours on the smallest of them (small star); the number
of rounds grows with the logarithm of the longest path. The links of a node are
dealt to up to 1,024 parts, each joined with its own copy of the node's minimum,
so a node with many links is no hot key. Every round is written to the shared
checkpoint folder.

A round is some fourteen shuffles. Where no more than ``FEW`` links are left, one
task joins them in memory instead; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.operators.checkpoint import Rounds, durable

#: Links that one task may hold.
FEW = 500_000


def _spanning(batches):
    """Links of a batch reduced to a forest: each node with its smallest known root."""
    import pyarrow as pa

    for batch in batches:
        root: dict[int, int] = {}

        def find(x, root=root):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        nodes = [n for n in root if find(n) != n]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["a", "b"])


def _joined(batches):
    """All links of a task: each node that is no root with its root."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [n for n in root if find(n) != n]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "root"])


def _hang(links: DataFrame, both_ways: bool, parts: int = 1024) -> DataFrame:
    """One star step over links (a > b). A node's links are dealt to parts, so that a hub is no one task's work."""
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    ends = ends.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    partial = ends.groupBy("a", "part").agg(F.min("b").alias("low"))
    least = partial.groupBy("a").agg(F.least(F.col("a"), F.min("low")).alias("least"))
    spread = partial.select("a", "part").join(least, "a")  # at most ``parts`` rows a node
    moved = ends.join(spread, ["a", "part"])
    if both_ways:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.where(F.col("b") > F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) of every linked node but the roots; ``links`` has columns a and b.

    The root of a component is its smallest node. Self-links and repeated links
    are ignored.
    """
    pairs = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    pairs = durable(pairs.where("a <> b").mapInArrow(_spanning, "a long, b long").distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before, rounds = state(pairs), Rounds()
    for _ in range(max_rounds):
        if before[0] <= few:
            out = durable(pairs.coalesce(1).mapInArrow(_joined, "node long, root long"))
            rounds.drop()
            return out
        pairs = rounds.keep(_hang(_hang(pairs, True), False))
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    out = durable(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")))
    rounds.drop()
    return out
