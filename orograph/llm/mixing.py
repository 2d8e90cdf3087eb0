"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Sources get shares of a token budget by weight; a source whose share is above
``most`` times its own size is held there, and what it leaves is shared again by
weight among the others. Every document, shuffled within its source, stands in
its source's queue once for each possible repeat and gets a virtual finish time:
the source's tokens up to and with it, divided by the source's target. The
queues are put in one order by a global range sort on that time, running totals
over this order are taken, and the order is cut where the budget is used up. At
any such cut all sources have had the same part of their targets, up to a
document each. Documents are taken whole.

Scale: texts are read once; what is shuffled are (source, id, size) rows, once
for the queues and once for the mix. A running total is a window inside each
range and one row a range, so no source, however large, is one task's work.
Documents alike in source, id and size are one row with a count until they are
dealt. Sources are numbered and their targets found by the same running totals,
so they may be many. Sums are of whole numbers and the shuffle is a hash of the
id, so reruns agree.

Cases: a null text has size 0. Sources stand in code point order, null last.
Documents of size 0 are never taken and neither help nor hinder. Documents
without an id are shuffled by their size. Rows alike in source, id and size can't
be told apart; their repeats are dealt one after the other. A source without any
word has target 0. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import durable

#: What white space between words is, as a set of a regular expression.
SPACE = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of words of a text, which are what white space parts."""
    inner = F.regexp_replace(text, f"^{SPACE}+", "")
    pieces = F.size(F.split(inner, f"{SPACE}+"))
    # A text that ends in white space has an empty piece there.
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(pieces - F.when(inner.rlike(f"{SPACE}\\z"), 1).otherwise(0)).cast("long")


def running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the total of its column over the rows before this one in ``order``.

    Rows are dealt to ranges of the order; totals inside a range come from a
    window, those of the ranges before it from one row a range.
    """
    placed = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_of_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    per = per.select("_range", *(F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_of_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(per), "_range")  # one small row a range
    return out.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_of_{n}") for n, c in sums.items()}).drop("_range", *(f"_of_{n}" for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size) with the source's place ``nth`` and its ``target``.

    With sources ordered by the level at which they are full (their limit over
    their weight), those full are the first ones: the level that the remaining
    budget gives to the remaining weights falls below a source's own level first
    at the source from which on none is full.
    """
    by_name = [F.col("source").asc_nulls_last()]
    placed = running(sizes, by_name, {"nth": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    placed = placed.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    placed = placed.withColumn("full_at", F.col("limit") / F.col("weight"))
    whole = placed.agg((F.sum("source_size") * percent / 100).alias("budget"), F.sum("weight").alias("weights"))
    ordered = running(placed, [F.col("full_at").asc(), F.col("nth").asc()], {"limits": F.col("limit"), "lighter": F.col("weight")}).join(F.broadcast(whole))  # one row
    level = (F.col("budget") - F.col("limits")) / (F.col("weights") - F.col("lighter"))
    ordered = durable(ordered.withColumn("level", level))
    settled = ordered.where("level <= full_at").agg(F.min_by("level", F.struct("full_at", "nth")).alias("settled"))
    target = F.when(F.col("settled").isNull() | (F.col("full_at") <= F.col("settled")), F.col("limit").cast("double")).otherwise(F.col("settled") * F.col("weight"))
    return ordered.join(F.broadcast(settled)).select("source", "nth", "source_size", target.alias("target"))  # one row


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; ``most`` is a whole number."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(n_words(F.col("text").cast("string")), F.lit(0).cast("long")).alias("size"))
    folded = durable(own.groupBy("source", "doc_id", "size").agg(F.count("*").alias("alike")))
    sizes = folded.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"))
    goals = durable(targets(sizes, weights, percent, most))
    before = running(goals, [F.col("nth").asc()], {"source_start": F.col("source_size")})
    entries = folded.join(before, folded["source"].eqNullSafe(before["source"])).drop(before["source"])
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    entries = entries.withColumn("mark", mark).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "alike")))
    queued = running(entries, [F.col(c).asc() for c in ("nth", "mark", "doc_id", "size", "copy")], {"start": F.col("size")})
    queued = durable(queued.withColumn("upto", F.col("start") - F.col("source_start") + F.col("size")).select("doc_id", "nth", "mark", "copy", "size", "source_size", "target", "upto"))
    finish = lambda turn: (F.col("upto") + turn * F.col("source_size")) / F.col("target")
    key = ["finish", "nth", "turn", "mark", "doc_id", "size", "copy"]
    turns = queued.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish(F.col("turn")))
    order = running(turns.select(*key), [F.col(c).asc() for c in key], {"mixed": F.col("size")})
    budget = goals.agg(F.coalesce(F.floor(F.sum("target") + F.lit(0.5)), F.lit(0)).alias("budget"))
    fits = order.join(F.broadcast(budget)).where(F.col("mixed") + F.col("size") <= F.col("budget"))  # one row
    last = fits.agg(F.max(F.struct(*key)).alias("last"))  # one row
    out = queued.join(F.broadcast(last))
    own_key = lambda turn: F.struct(*(x.alias(n) for n, x in zip(key, (finish(F.lit(turn)), F.col("nth"), F.lit(turn), F.col("mark"), F.col("doc_id"), F.col("size"), F.col("copy")), strict=True)))
    times = sum((F.when((F.col("size") > 0) & (own_key(turn) <= F.col("last")), 1).otherwise(0) for turn in range(most)), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
lv AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS full_at FROM w),
p AS (SELECT *, ((SELECT sum(source_size) FROM lv) * 150 / 100 - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM lv) - coalesce(sum(weight) OVER o, 0)) AS level
      FROM lv WINDOW o AS (ORDER BY full_at, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, (full_at, nth)) AS settled FROM p WHERE level <= full_at),
t AS (SELECT p.*, CASE WHEN settled IS NULL OR full_at <= settled THEN cap::DOUBLE ELSE settled * weight END AS target FROM p, l),
e AS (SELECT d.doc_id, d.size, t.nth, t.source_size, t.target, md5('1:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, row_number() OVER (PARTITION BY nth, doc_id, size) AS copy FROM e),
u AS (SELECT *, sum(size) OVER (PARTITION BY nth ORDER BY mark, doc_id NULLS FIRST, size, copy) AS upto FROM q),
k AS (SELECT *, (upto + turn * source_size) / target AS finish FROM u, (VALUES (0), (1)) v(turn) WHERE size > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, nth, turn, mark, doc_id NULLS FIRST, size, copy) AS mixed FROM k),
b AS (SELECT floor(sum(target) + 0.5) AS budget FROM t),
got AS (SELECT nth, doc_id, size, copy, count(*) AS times FROM m, b WHERE mixed <= budget GROUP BY ALL)
SELECT u.doc_id, u.size, u.source_size, u.target, (coalesce(times, 0) * u.size)::BIGINT AS taken
FROM u LEFT JOIN got ON got.nth = u.nth AND got.doc_id IS NOT DISTINCT FROM u.doc_id AND got.size = u.size AND got.copy = u.copy
"""
