"""Links between fingerprints whose nearest links fail the check on the texts."""

import random

import pytest

from orograph.llm import simhash


def linked(spark, prints, texts, group_rows):
    """The smallest index that each of the fingerprints is joined to."""
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    nodes = spark.createDataFrame(list(zip(range(len(prints)), signed)), "node long, fp long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = simhash.similar_links(nodes, docs, bits=5, group_rows=group_rows).collect()
    return joined(len(prints), [(r["a"], r["b"]) for r in pairs])


def joined(n, pairs):
    least = list(range(n))
    for a, b in pairs:
        low, high = sorted((least[a], least[b]))
        least = [low if x == high else x for x in least]
    return least


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 2])
def test_a_failing_hub_does_not_part_two_copies(spark, group_rows):
    draw = random.Random(4)
    words = lambda: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(30))
    prints, texts = [], []
    for _ in range(30):  # three, four and three bits apart in one segment, so that all three share all other keys
        hub, copy = draw.getrandbits(64), words()
        prints += [hub, hub ^ 0b00111, hub ^ 0b11100]
        texts += [words(), copy, copy + " more"]
    want = [i - 1 if i % 3 == 2 else i for i in range(90)]
    assert linked(spark, prints, texts, group_rows) == want


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 7])
def test_a_crowded_group_is_checked_whole(spark, group_rows):
    draw = random.Random(6)
    base, prints = draw.getrandbits(64), []
    while len(prints) < 60:
        v = base ^ draw.getrandbits(14)
        if all((v ^ p).bit_count() > 2 for p in prints):
            prints.append(v)
    kinds = [" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(30)) for _ in range(15)]
    texts = [draw.choice(kinds) for _ in prints]
    close = [(a, b) for a in range(60) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 5 and texts[a] == texts[b]]
    assert linked(spark, prints, texts, group_rows) == joined(60, close)


def test_every_close_pair_is_told_once(spark):
    draw = random.Random(7)
    base = [draw.getrandbits(64) for _ in range(30)]
    prints = [v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 8))) for v in base for _ in range(10)]
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    nodes = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(signed)], "node long, fp long, root long")
    want = sorted((a, b) for b in range(len(prints)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 10 and a % 3 != b % 3)
    for kept, group_rows in ((2, 100_000), (2, 4), (3, 100_000), (4, 6)):
        assert sorted((r["a"], r["b"]) for r in simhash.close_pairs(nodes, 10, kept, group_rows).collect()) == want


def test_longer_keys_for_more_fingerprints():
    assert [simhash.kept_segments(10, n) for n in (1, 10**6, 10**12)] == sorted(simhash.kept_segments(10, n) for n in (1, 10**6, 10**12))
    assert simhash.kept_segments(10, 10**5) == 2 < simhash.kept_segments(10, 10**10)


def test_a_hub_of_many_links(spark):
    from orograph.llm.components import components

    links = spark.range(1, 3000).selectExpr("id as a", "0L as b").union(spark.range(5000, 5100).selectExpr("id as a", "id - 1 as b"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 3000)}, **{i: 4999 for i in range(5000, 5100)}}
