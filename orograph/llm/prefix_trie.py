"""A prefix trie of conversations: what caching shared beginnings would save.

Conversations are rebuilt (``rebuilt``), and each distinct sequence of their
first d turns is a node. Turns are told by 128-bit digests; a prefix is the
exclusive or of the digests of its turns with their positions. Equal prefixes
are folded to one node with a count before anything is gathered, so copies of a
conversation cost one row.

Nodes are hash-partitioned by the digest of their first turn. A task builds the
tries of its first turns as pointers in a dictionary and walks them in iterative
postorder, so a deep trie needs no recursion. The subtrie of a first turn with
more than ``limit`` nodes is set aside down to where it first branches and what
hangs below is partitioned anew by the next turn, until no subtrie is oversized;
totals of those subtries are then carried up into the part set aside. That part
is a chain in each round, and its totals are running sums in blocks of depths,
so a very long conversation is no one task's work either. Rounds number the
branchings on a path that still have more than ``limit`` nodes below them.

Scale: turns are shuffled for numbering, rebuilding and folding, without their
texts; a task holds about ``bucket`` nodes and at most ``limit`` of one first
turn. The digest of the conversations that end in a node reads their ids in
order, 24 bytes a row, from a sorted stream: a digest is made in one pass, so
the ids of one node pass one task, but never lie in its memory together.

Cases: turns are ordered by (turn, role, text), null turns first; null role and
text are empty; repeated rows are repeated turns. Rows without a conv_id belong
to no conversation and take no part. A conversation whose turns all fall to the
shared beginning of an absent one is turnless and ends in the root. Without any
conversation there is no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.chat import positions
from orograph.llm.common import durable

BLOCK = 256
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "h1 long, h2 long, parent_conv long, n_children long, n_leaves long, saved long"


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation, and the turns (conv, at, d1, d2, chars) of its rebuilt sequence.

    Conversation c begins with the first h turns of conversation c - c % ``every``,
    h being crc32(c) % ``most``, and goes on with its own turns after its first h.
    A beginning is at most ``most`` - 1 turns, and one conversation begins fewer
    than 2 * ``every`` others.
    """
    rows = positions(turns.where("conv_id is not null"))
    own = durable(rows.select("conv", "at", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("second"), "text", "role").alias("d2"), F.length("text").cast("long").alias("chars")))
    convs = own.groupBy("conv").agg(F.max("at").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % most, "base": F.col("conv") - F.col("conv") % every})
    bases = convs.where("conv = base").select("base", F.col("n").alias("base_n"))
    convs = durable(convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv", "base", "h", "shared"))
    heads = own.where((F.col("at") < most) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    begun = convs.join(heads, "base").where("at <= shared").select("conv", "at", "d1", "d2", "chars")
    rest = own.join(convs.select("conv", "h", "shared"), "conv").where("at > h")
    return convs.select("conv"), begun.unionByName(rest.select("conv", (F.col("at") - F.col("h") + F.col("shared")).alias("at"), "d1", "d2", "chars"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv, at, chars) with the hash (h1, h2) of their prefix, of the one before it (p1, p2) and of its first turn (g1, g2)."""
    marked = turns.select("conv", "at", "chars", F.floor(F.col("at") / BLOCK).alias("block"), F.xxhash64("at", "d1", "d2").alias("m1"), F.xxhash64(F.lit("second"), "d2", "d1", "at").alias("m2"))
    marked = durable(marked)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = earlier.rowsBetween(Window.unboundedPreceding, 0)
    first = lambda i: F.max(F.when(F.col("at") == 1, F.col(f"m{i}"))).alias(f"f{i}")
    sums = marked.groupBy("conv", "block").agg(*(F.bit_xor(f"m{i}").alias(f"x{i}") for i in (1, 2)), first(1), first(2))
    sums = sums.select("conv", "block", *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)), *(F.max(f"f{i}").over(so_far).alias(f"g{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = marked.join(sums, ["conv", "block"])
    for i in (1, 2):
        rolled = rolled.withColumn(f"h{i}", F.bit_xor(f"m{i}").over(upto).bitwiseXOR(F.col(f"b{i}"))).withColumn(f"p{i}", F.col(f"h{i}").bitwiseXOR(F.col(f"m{i}")))
    return rolled.select("conv", "at", "chars", "h1", "h2", "p1", "p2", "g1", "g2")


def postorder(h1, h2, p1, p2, conv, n_convs, chars):
    """Parent conversation, children, leaves and saved tokens of each node of some tries, and which nodes are tops.

    The children of a node hang in a dictionary of the nodes' hashes; nodes are
    met children first, from a stack.
    """
    at = {key: i for i, key in enumerate(zip(h1, h2, strict=True))}
    children: list[list[int]] = [[] for _ in h1]
    up = [at.get(key, -1) for key in zip(p1, p2, strict=True)]
    for i, j in enumerate(up):
        if j >= 0:
            children[j].append(i)
    leaves = [0] * len(up)
    saved = [(n - 1) * c for n, c in zip(n_convs, chars, strict=True)]
    for top in (i for i, j in enumerate(up) if j < 0):
        stack = [(top, False)]
        while stack:
            i, met = stack.pop()
            if not met:
                stack.append((i, True))
                stack += [(j, False) for j in children[i]]
                continue
            leaves[i] = sum(leaves[j] for j in children[i]) or 1
            saved[i] += sum(saved[j] for j in children[i])
    return [conv[j] if j >= 0 else None for j in up], [len(c) for c in children], leaves, saved


def _tries(pdf):
    """The nodes of the tries of a bucket with what their subtries hold."""
    import pandas as pd

    columns = (pdf[c].tolist() for c in ("h1", "h2", "p1", "p2", "conv", "n_convs", "chars"))
    parent, children, leaves, saved = postorder(*columns)
    parent = pd.array(parent, "Int64").fillna(pdf["up_conv"].astype("Int64"))
    return pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "parent_conv": parent, "n_children": children, "n_leaves": leaves, "saved": saved})


def _below(rows: DataFrame) -> DataFrame:
    """Nodes of chains (g1, g2, at, own), with ``run``: the sum of ``own`` over the nodes of the chain at this depth or below."""
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    deeper = Window.partitionBy("g1", "g2").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("g1", "g2", "block").agg(F.sum("own").alias("s"))
    sums = sums.select("g1", "g2", "block", F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("after"))
    inside = Window.partitionBy("g1", "g2", "block").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["g1", "g2", "block"]).withColumn("run", F.sum("own").over(inside) + F.col("after")).drop("block", "after")


def _aside(nodes: DataFrame, rolled: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to do with nodes (with their group g1, g2): those of small groups, the chains of large ones, and their rest in new groups."""
    per_depth = nodes.groupBy("g1", "g2", "at").agg(F.count("*").alias("n"))
    groups = per_depth.groupBy("g1", "g2").agg(F.sum("n").alias("nodes"), F.min(F.when(F.col("n") > 1, F.col("at"))).alias("branch"), F.max("at").alias("deepest"))
    large = durable(groups.where(F.col("nodes") > limit).select("g1", "g2", F.coalesce("branch", F.col("deepest") + 1).alias("branch")))
    small = nodes.join(large, ["g1", "g2"], "left_anti")
    inside = nodes.join(large, ["g1", "g2"])
    chain = durable(inside.where("at < branch"))
    # A node's ancestor at the branching depth is its smallest member's prefix there.
    ends = chain.where("at = branch - 1").select("g1", "g2", F.col("conv").alias("up"))
    rest = inside.where("at >= branch").drop("up_conv").join(ends, ["g1", "g2"]).withColumnRenamed("up", "up_conv").drop("g1", "g2")
    heads = rolled.select("conv", F.col("at").alias("branch"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    wanted = rest.select("conv", "branch").distinct()
    rest = durable(rest.join(heads.join(wanted, ["conv", "branch"], "left_semi"), ["conv", "branch"]).drop("branch"))
    return small, chain.drop("branch"), rest


def _ending(batches):
    """For ids in order of their node: per node the digest of its ids, joined by commas."""
    import pyarrow as pa

    held, digest = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, b) == held:
                digest.update(b",%d" % conv)
                continue
            if held:
                out.append((*held, digest.hexdigest()))
            held, digest = (a, b), hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "ends"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([digest.hexdigest()])], names=["h1", "h2", "ends"])


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def trie(turns: DataFrame, limit: int = 2_000, bucket: int = 20_000) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    convs, sequences = rebuilt(turns)
    convs, rolled = durable(convs), durable(prefixes(sequences))
    nodes = rolled.groupBy("h1", "h2", "at").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("chars", "p1", "p2", "g1", "g2")))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    nodes = durable(nodes.join(F.broadcast(root.select(F.col("conv").alias("up_conv")))))  # one row
    facts = nodes.select("h1", "h2", "at", "conv", "n_convs")

    ready, chains, rest = [], [], nodes
    while not rest.isEmpty():
        small, chain, rest = _aside(rest, rolled, limit)
        ready.append(small)
        chains.append(chain)
    built = None
    if ready:
        small = ready[0]
        for more in ready[1:]:
            small = small.unionByName(more)
        small = durable(small)
        buckets = small.count() // bucket + 1
        grouped = small.groupBy(F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).alias("bucket"))
        built = durable(grouped.applyInPandas(_tries, _NODE).join(facts, ["h1", "h2"]).join(nodes.select("h1", "h2", "p1", "p2"), ["h1", "h2"]))
    # Chains from the deepest round up: each ends in a node whose subtries are ready by then.
    for chain in reversed(chains):
        if chain.isEmpty():
            continue
        ends = chain.groupBy("g1", "g2").agg(F.max("at").alias("at"))
        last = chain.join(ends, ["g1", "g2", "at"]).select("g1", "g2", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
        under = built.select("p1", "p2", "n_leaves", "saved").join(last, ["p1", "p2"]).groupBy("g1", "g2").agg(F.count("*").alias("many"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
        summed = _below(chain.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))).join(ends.withColumnRenamed("at", "end"), ["g1", "g2"]).join(under, ["g1", "g2"], "left")
        parents = chain.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("inner_conv"))
        done = summed.join(parents, ["p1", "p2"], "left").select(
            "h1", "h2", F.coalesce("inner_conv", "up_conv").alias("parent_conv"),
            F.when(F.col("at") < F.col("end"), F.lit(1)).otherwise(F.coalesce("many", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("run") + F.coalesce("more", F.lit(0))).alias("saved"),
            "at", "conv", "n_convs", "p1", "p2",
        )
        built = durable(built.unionByName(done))
    none = F.lit(0).cast("long")
    if built is None:
        built = nodes.select("h1", "h2", F.col("up_conv").alias("parent_conv"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved"), "at", "conv", "n_convs", "p1", "p2")
    tops = built.where("at = 1").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    top = root.where("n_convs > 0").join(F.broadcast(tops)).select(none.alias("h1"), none.alias("h2"), F.lit(None).cast("long").alias("parent_conv"), "n_children", "n_leaves", "saved", none.alias("at"), "conv", "n_convs")  # one row

    whole = rolled.groupBy("conv").agg(F.max_by(F.struct("h1", "h2"), "at").alias("h"))
    ids = convs.join(whole, "conv", "left").select(F.coalesce("h.h1", none).alias("h1"), F.coalesce("h.h2", none).alias("h2"), "conv")
    ends = ids.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "conv").mapInArrow(_ending, "h1 long, h2 long, ends string")
    out = built.select(top.columns).unionByName(top).join(ends, ["h1", "h2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", _long("n_children"), _long("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


ORACLE = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': role, 't': text} ORDER BY pos) AS turns FROM o GROUP BY c),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h FROM l),
s AS (SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
p AS (SELECT c, d, turns[1:d] AS node, turns[1:d - 1] AS up, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (SELECT node, d, min(c) AS conv, count(*) AS n_convs, any_value(up) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
             CASE WHEN d > 0 THEN (count(*) - 1) * len(any_value(node[-1].t)) ELSE 0 END AS own FROM p GROUP BY node, d),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
t AS (SELECT node[1:e] AS node, e AS d, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv AS conv_id, m.d AS depth, u.conv AS parent_conv_id, m.n_convs, m.n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN t USING (node, d) LEFT JOIN n u ON u.node = m.up AND u.d = m.d - 1
"""
