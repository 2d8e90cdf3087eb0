"""Sharding by sampled splitters, so that shards hold nearly equal bytes.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of
keys gives quantile boundaries, records fall into the ranges between them, and
ranges found overfull are cut again at keys sampled inside them. Exact totals of
the ranges and running sums inside each then give every record's place in the
whole order in bytes and rows, and a shard is an equal part of the bytes.

Equal texts are neighbours in this order, and stay in one shard where they make
up less than ``together`` of a shard; larger groups are cut by doc_id.

Scale: the texts are read once and not moved; (key, size, checksum) rows are
shuffled once, by range. A hot text spreads over as many ranges as its bytes
ask for. The driver sees the sampled keys (about ``per_range`` for each of the
ranges, and there is one range for every ``range_rows`` rows or 1/8 of a shard)
and the totals of the ranges.

Cases: null text has size ``overhead`` and checksum 0; null doc_id sorts first.
Records equal in text and doc_id are one key, which can't be cut between ranges;
they still go to different shards. A record larger than a shard's share
makes its shard larger. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import durable

_LEAST = -(2**63)


def records(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size, checksum and order key of each document."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def splitters(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """At most ``parts`` - 1 boundary keys at equal steps of the sample's weight.

    A boundary is the first key of its range. One whose hash occurs once stands
    before all records of that hash, so only texts worth several parts are cut.
    """
    if not sample:
        return []
    sample = sorted(sample)
    run = np.cumsum([w for _, _, w in sample])
    at = np.searchsorted(run, run[-1] * np.arange(1, parts) / parts)
    keys = [sample[min(i, len(sample) - 1)][:2] for i in at.tolist()]
    times: dict[int, int] = {}
    for h, _ in keys:
        times[h] = times.get(h, 0) + 1
    return sorted({(h, d if times[h] > 1 else _LEAST) for h, d in keys})


def in_ranges(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: the number of boundaries at or below a record's key."""
    hashes = np.array([h for h, _ in bounds], np.int64)
    ids = np.array([d for _, d in bounds], np.int64)
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(names.index("h")).to_numpy()
            doc = batch.column(names.index("doc_id")).fill_null(_LEAST).to_numpy()
            low, place = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            tied = np.flatnonzero(low < place)
            for a in np.unique(low[tied]).tolist():
                mine = tied[low[tied] == a]
                place[mine] = a + np.searchsorted(ids[a : place[mine[0]]], doc[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], names=[*names, "range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, range int")


def _drawn(rows: DataFrame, step: float, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with a chance in proportion to size, one for every ``step`` bytes, with their weights."""
    got = rows.where(F.rand(seed) < F.col("size") / F.lit(step)).select("h", F.coalesce("doc_id", F.lit(_LEAST)), F.greatest(F.col("size").cast("double"), F.lit(step)))
    return [tuple(r) for r in got.toLocalIterator()]


def sharded(docs: DataFrame, shards: int = 40, overhead: int = 16, together: float = 0.01, range_rows: int = 200_000, per_range: int = 24, rounds: int = 30) -> DataFrame:
    """Shard and slot of every document, under the law of nearly equal bytes."""
    rows = durable(records(docs, overhead))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not count:
        total = 1
    wanted = max(8 * shards, -(-count // range_rows))
    share = total / wanted
    bounds = splitters(_drawn(rows, share / per_range, 11), wanted)
    for seed in range(12, 12 + rounds):
        placed = in_ranges(rows, bounds)
        held = {r["range"]: r for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        over = [r for r, x in held.items() if x["bytes"] > 2 * share or x["n"] > 2 * range_rows]
        if not over:
            break
        inside = placed.where(F.col("range").isin(over)).select("h", "doc_id", "size", "range")
        drawn: dict[int, list] = {}
        for r in inside.where(F.rand(seed) < F.col("size") * F.lit(4 * per_range / share)).toLocalIterator():
            key = (r["h"], _LEAST if r["doc_id"] is None else r["doc_id"])
            drawn.setdefault(r["range"], []).append((*key, max(r["size"], share / per_range / 4)))
        more = [b for r, s in drawn.items() for b in splitters(s, 2 + int(max(held[r]["bytes"] / share, held[r]["n"] / range_rows)))]
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    first_row, first_byte, before = {}, {}, [0, 0]
    for r in sorted(held):
        first_row[r], first_byte[r] = before
        before = [before[0] + held[r]["n"], before[1] + held[r]["bytes"]]
    spark = rows.sparkSession
    starts = spark.createDataFrame([(r, first_row[r], first_byte[r]) for r in sorted(held)] or [(-1, 0, 0)], "range int, first_row long, first_byte long")
    order = Window.partitionBy("range").orderBy("h", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("range", "h").orderBy("place")
    whole = Window.partitionBy("range", "h")
    target = total / shards
    placed = (
        placed.join(F.broadcast(starts), "range")  # one small row for each range
        .withColumn("nth", F.row_number().over(order))
        .withColumn("place", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("first_byte"))
        .withColumn("group_place", F.first("place").over(group))
        .withColumn("group_bytes", F.sum("size").over(whole))
    )
    middle = F.when(F.col("group_bytes") <= together * target, F.col("group_place") + F.col("group_bytes") / 2).otherwise(F.col("place") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int")).withColumn("row", F.col("first_row") + F.col("nth") - 1)
    placed = durable(placed.select("doc_id", "size", "text_crc32", "shard", "row"))
    opening = placed.groupBy("shard").agg(F.min("row").alias("opening"))  # a row for each shard
    return placed.join(F.broadcast(opening), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("opening")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
