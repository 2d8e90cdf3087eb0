"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

Systems that log a conversation after each turn leave every prefix of it behind.
A rolling hash over the turns so far (the exclusive or of 128-bit hashes of
position, role and text) identifies prefixes; conversations whose whole hash is
the hash of a proper prefix of a longer one go by an anti-join, and of equal
conversations the one with the smallest conv_id stays. What remains is rendered.

Scale: positions and hashes are running counts and sums inside blocks of
``BLOCK`` turn numbers, put together by one row per block, so that a very long
conversation is spread over tasks. Equal prefixes are folded before the join, so
a very common first turn is one row. Rendered text comes in parts of at most
``PART`` turns, so that no group is unbounded.

Cases: null role and null text count as empty; null conv_id is a conversation of
its own; turns are ordered by (turn, role, text), null turns first, and gaps in
their numbers do not matter. Repeated rows are repeated turns. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import durable

BLOCK, PART = 256, 64
_NULL = -(2**63)


def positions(turns: DataFrame) -> DataFrame:
    """Each turn (conv, block, role, text) with its position ``at`` from 1 in its conversation."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NULL)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_NULL)))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = counts.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(before, ["conv", "block"])
    return rows.withColumn("at", F.col("before") + F.col("nth"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its position from 1, its own hash and the hash of the turns up to it (two longs each)."""
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = positions(turns).withColumns({
        "m1": F.xxhash64("at", "role", "text"),
        "m2": F.xxhash64(F.lit("second"), "text", "role", "at"),
    })
    rows = durable(rows.select("conv", "block", "at", "role", "text", "m1", "m2"))
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    sums = sums.select("conv", "block", *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.join(sums, ["conv", "block"])
    for i in (1, 2):
        rolled = rolled.withColumn(f"h{i}", F.bit_xor(f"m{i}").over(upto).bitwiseXOR(F.col(f"b{i}")))
    return rolled.drop("b1", "b2", "block")


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that are no proper prefix of another, the least of equal ones."""
    whole = rolled.groupBy("conv").agg(F.max("at").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "at").alias("h"))
    whole = whole.groupBy("n_turns", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.min("conv").alias("conv"))
    # What stands before a turn is a proper prefix: its hash without that turn's.
    proper = rolled.where("at > 1").select(
        (F.col("at") - 1).alias("n_turns"), F.col("h1").bitwiseXOR(F.col("m1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("m2")).alias("h2")
    )
    return whole.join(proper.distinct(), ["n_turns", "h1", "h2"], "left_anti").select("conv", "n_turns")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and text of the maximal conversations, ``PART`` turns a row."""
    rolled = durable(prefixes(turns))
    kept = maximal(rolled)
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    rows = rolled.join(kept, "conv").select("conv", "n_turns", "at", F.floor((F.col("at") - 1) / PART).cast("int").alias("part"), line.alias("line"))
    parts = rows.groupBy("conv", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    conv = F.when(F.col("conv") != _NULL, F.col("conv"))
    return parts.select(conv.alias("conv_id"), "part", "n_turns", F.array_join(F.col("lines.line"), "").alias("text"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
k AS (SELECT min(conv_id) AS conv_id, n FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY n, l)
SELECT t.conv_id, ((pos - 1) // 64)::INT AS part, k.n AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN k USING (conv_id) GROUP BY t.conv_id, part, k.n
"""
