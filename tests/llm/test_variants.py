"""Near copies meet on variants with one bit wiped out: the method's own index, and every pair within five bits."""

import random

import pytest

from orograph.llm import simhash


@pytest.mark.parametrize("group_rows", [100_000, 70, 3])
@pytest.mark.parametrize("bits", [0, 2, 4, 5])
def test_variants_tell_every_close_pair_once(spark, bits, group_rows):
    draw = random.Random(bits)
    base = [draw.getrandbits(64) for _ in range(12)]
    prints = [v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for v in base for _ in range(15)]
    prints += [base[0] ^ draw.getrandbits(20) for _ in range(90)]  # two segments the same: groups of more than FEW_ROWS
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    nodes = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(signed)], "node long, fp long, root long")
    want = sorted((a, b) for b in range(len(prints)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= bits and a % 3 != b % 3)
    assert sorted((r["a"], r["b"]) for r in simhash.close_pairs(nodes, bits, group_rows=group_rows).collect()) == want
    assert bits == 0 or len(want) > 20


def test_five_bits_need_three_segments_with_one_bit_wiped(spark):
    draw, least = random.Random(9), []
    for _ in range(20):  # the worst way to deal five bits: two, two and one
        v = draw.getrandbits(64)
        ends = ((0, 21, 2), (21, 42, 2), (42, 64, 1))
        least.append((v, v ^ sum(1 << b for low, high, many in draw.sample(ends, 3) for b in draw.sample(range(low, high), many))))
    signed = [(2 * i + k, v - (1 << 64) if v >> 63 else v, 2 * i + k) for i, pair in enumerate(least) for k, v in enumerate(pair)]
    nodes = spark.createDataFrame(signed, "node long, fp long, root long")
    assert sorted(map(tuple, simhash.close_pairs(nodes, 5).collect())) == [(2 * i, 2 * i + 1) for i in range(20)]
    keys = nodes.select("fp", simhash._variants(nodes["fp"], 3).alias("keys")).collect()
    assert all(len(set(r["keys"])) == 64 for r in keys)
