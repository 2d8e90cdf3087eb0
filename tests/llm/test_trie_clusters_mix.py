"""The prefix trie, centroid clustering and mixing against plain versions, on odd rows too."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from orograph.llm import clustering, mixing, prefix_trie, registry

NEW = ["op11_prefix_trie", "op12_weighted_lloyd", "op13_fair_queueing"]
TURNS = "conv_id long, turn long, role string, text string, at int, conv string, block int"


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, folder)
    want = con.execute(registry.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    at = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(map(repr, [tuple(r[n] for n in names) for r in got.collect()])) == sorted(map(repr, [tuple(r[i] for i in at) for r in want.fetchall()]))


# --- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def trie_of(spark, rows, **more):
    wide = [(*r, 1, "x", 2) for r in rows]
    got = prefix_trie.trie(spark.createDataFrame(wide, TURNS), **more).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def odd_turns():
    draw, rows = random.Random(5), []
    for conv in [*range(-3, 130), 200, 250, 399, 1001]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn * 3, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None, "é" * 7])))
    rows += [(None, 1, "user", "lost"), (7, None, "system", "first"), (7, None, "system", "first"), (7, 0, None, None)]
    rows += [(5000, 0, "user", "x" * 300_000), (5001, 0, "user", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("limit", [2_000, 30, 2])
def test_trie_of_odd_turns(spark, limit):
    rows = odd_turns()
    assert trie_of(spark, rows, limit=limit, bucket=50) == plain_trie(rows)


def test_trie_of_a_hot_beginning_and_a_long_conversation(spark):
    # From id 10,000 on no base exists, so conversations lose their first turns: begin them with ones that don't matter.
    rows = []
    for k in range(60):
        conv = 10_001 + k
        lost = zlib.crc32(str(conv).encode()) % 6
        rows += [(conv, i, "x", "lost") for i in range(lost)]
        rows += [(conv, 10 + i, "user", "same") for i in range(12)]
        rows += [(conv, 30, "user", str(k % 20)), (conv, 31, "user", str(k % 7))]
    rows += [(20_001, i, "user", f"turn {i // 2}") for i in range(1_500)]
    assert trie_of(spark, rows, limit=10, bucket=40) == plain_trie(rows)


def test_trie_without_conversations_and_with_only_turnless_ones(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "a")]) == []
    gone = next(c for c in range(10_001, 10_100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(gone, 0, "user", "a"), (gone, 1, "user", "b")]
    assert trie_of(spark, rows) == plain_trie(rows) == [(gone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]


# --- centroid clustering

VECTORS = "vec_id long, embedding array<float>, q int, weight string, cluster string"


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        near = defaultdict(list)
        for _, v in kept:
            near[nearest(v)[1]].append(v)
        for j, mine in near.items():
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = defaultdict(int)
    for _, j, d in placed:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i if i is not None else -1), j, d, per[j], sum(per.values()), digest[j]) for i, j, d in placed)


def clusters_of(spark, rows):
    got = clustering.clustered(spark.createDataFrame([(*r, 1, "w", "c") for r in rows], VECTORS)).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def some_vectors(many):
    draw = np.random.default_rng(3)
    return [(i, [float(np.float32(x)) for x in draw.normal(0, 0.3, 64)]) for i in range(many)]


def test_clusters_of_odd_vectors(spark):
    rows = some_vectors(60)
    same = rows[3][1]
    rows += [(100 + i, same) for i in range(200)]  # a vector with most of the rows
    rows += [(300, None), (301, [0.5] * 63), (302, [None] + [0.5] * 63), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [0.0] * 64), (306, []), (5, rows[5][1]), (None, same)]
    assert clusters_of(spark, rows) == plain_clusters(rows)


@pytest.mark.parametrize("many", [0, 1, 5, 17])
def test_clusters_of_few_vectors(spark, many):
    rows = some_vectors(many)
    assert clusters_of(spark, rows) == plain_clusters(rows)
    equal = [(i, [0.25] * 64) for i in range(many)]
    assert clusters_of(spark, equal) == plain_clusters(equal)


def test_distances_of_large_components_are_exact(spark):
    big = float(np.float32(200_000.0))
    rows = [(i, [big if i % 2 else -big] * 63 + [float(i)]) for i in range(30)]
    assert clusters_of(spark, rows) == plain_clusters(rows)


# --- mixing

DOCS = "doc_id long, source string, text string, lang string, size string, target string, nth int"


def mix_of(spark, rows, **more):
    got = mixing.mixed(spark.createDataFrame([(*r, "en", "s", "t", 1) for r in rows], DOCS), **more)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return got.collect()


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


def test_mix_reaches_its_targets_and_repeats(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "a", "a", "b", "B", "é", "z", None]), "w " * draw.randint(0, 60)) for i in range(3_000)]
    rows += [(5_000, "tiny", "one two"), (5_001, "empty", "")]
    got = mix_of(spark, rows)
    source = {i: s for i, s, _ in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s, t in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61 + 0.01 * want[s]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_of(spark, random.Random(2).sample(rows, len(rows)))))


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None), (None, "a", "x y"), (None, "a", "x y"), (None, "a", "q r"), (1, "a", " \t\x0b "), (1, "a", "x"), (2, "a", "\n one\x0ctwo three \r"), (3, "b", "w " * 200_000)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"]) for r in mix_of(spark, rows))
    assert got == sorted([(-1, 0, 0), (-1, 2, 9), (-1, 2, 9), (-1, 2, 9), (1, 0, 9), (1, 1, 9), (2, 2, 9), (3, 200_000, 200_000)])
    assert mix_of(spark, []) == []
    assert [tuple(r)[1:] for r in mix_of(spark, [(1, "a", ""), (2, None, None)])] == [(0, 0, 0.0, 0)] * 2


def test_mix_of_rows_all_alike_and_of_more_repeats(spark):
    got = mix_of(spark, [(1, "a", "x y")] * 40 + [(2, "b", "x")] * 4)
    assert len(got) == 44 and sum(r["taken"] for r in got if r["doc_id"] == 2) <= 8
    more = mix_of(spark, [(i, "ab"[i % 2], "x " * 10) for i in range(40)], percent=250, most=3, weights=(1,))
    assert sum(r["taken"] for r in more) == 1_000 and all(r["taken"] in (0, 10, 20, 30) for r in more)


def test_mixing_runs_no_python(spark, small):
    got = registry.queries()["op13_fair_queueing"](spark, small)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    assert not any(w in got._jdf.queryExecution().explainString(mode) for w in ("Python", "Pandas", "Arrow"))
