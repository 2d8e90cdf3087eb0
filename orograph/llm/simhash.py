"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Two fingerprints that differ in
at most two bits differ in at most one bit of one segment, so the index holds,
for each segment, its 32 variants with one bit wiped out; equal variants meet by
an equality on (segment, wiped bit, rest), and the whole fingerprints are then
compared.

Scale: equal fingerprints are folded before the index, so a group of copies is
one entry. An index group yields a spanning forest of its links, never all
pairs; a group of more than ``group_rows`` is not compared inside a task but
passed on, and its fingerprints meet instead on variants with two of the 64 bits
wiped out, whose groups hold four fingerprints at most. So work stays linear in
the number of fingerprints and no link is lost. Components come from links by
star contraction in the shared checkpoint folder.

``near_copies`` reaches further, five bits, by the same variants: of ``bits`` // 2
+ 1 segments one at least differs in at most one bit, so the index holds each
segment with one bit wiped out, three of them for five bits. It then checks the
whole fingerprints and the texts. Segments of more bits apart get too short for
that; there keys wipe out whole segments: of ``bits`` + ``kept`` segments at least
``kept`` are equal, so every choice of ``kept`` of them is a key. ``kept`` grows
with the number of fingerprints; the pairs found are the same.

Cases: null and empty texts, and texts of white space, have no words and
fingerprint zero, and link like any other fingerprint. Texts of one or two words
have one shingle. Texts are read whole. Repeated rows give repeated result rows.
Other columns are ignored. An empty table gives no rows. Ties in a bit (exactly
half the shingles) leave it 0.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import durable
from orograph.llm.components import components

#: Rows of an index group that a task compares in memory.
GROUP_ROWS = 4096

#: Bits apart up to which near copies meet on variants with one bit wiped out, of 20 bits or more.
VARIANT_BITS = 5

#: Groups up to this size are compared many at once.
FEW_ROWS = 64


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: the majority of its shingles' hash bits."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) < size:
        marks = [hash_(b" ".join(words), seed)]
    else:
        marks = [hash_(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(size)), strict=False)]
    bits = np.zeros(64, np.int64)
    hashes = np.array(marks, ">u8")
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(marks)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, whole: bool = False) -> DataFrame:
    """doc_id and its fingerprint as a signed long; with ``whole`` also ``same``, a hash of all its words in order."""
    schema = "doc_id long, fp long" + ", same long" * whole

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            values = [[fingerprint(t, size, seed) for t in texts]]
            if whole:
                values.append([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), seed) for t in texts])
            cols = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "fp", "same"][: 1 + len(cols)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def _forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join whatever chains of close values join; at most one per value."""
    out, rest = [], values.view(np.uint64)
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            v = frontier.pop()
            near = np.bitwise_count(rest ^ v) <= bits
            if near.any():
                found = rest[near]
                out += [(v, f) for f in found]
                frontier += list(found)
                rest = rest[~near]
    return [tuple(x) for x in np.array(out, np.uint64).view(np.int64).reshape(-1, 2).tolist()]


def _index_links(bits: int, group_rows: int):
    """For rows (key, fp) in key order: links (a, b) within a key's group; of one too large, its fingerprints a and its key."""

    def run(batches):
        import pyarrow as pa

        def emit(links, large):
            a = [x for x, _ in links] + [x for _, x in large]
            b = [y for _, y in links] + [None] * len(large)
            of = [None] * len(links) + [k for k, _ in large]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, of)], names=["a", "b", "key"])

        held: list[np.ndarray] = []  # of the group that goes on in the next batch
        held_key, held_rows, spilling = None, 0, False
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            links: list[tuple[int, int]] = []
            large: list[tuple[int, int]] = []
            many = np.flatnonzero(np.diff(edges) > 1).tolist()
            last = len(edges) - 2
            for k in sorted({0, last, *many}) if len(keys) else ():
                group, key = values[edges[k] : edges[k + 1]], keys[edges[k]]
                if k == 0 and key == held_key:
                    held.append(group)
                else:
                    if held and not spilling and held_rows > 1:
                        links += _forest(np.concatenate(held), bits)
                    held, held_key, held_rows, spilling = [group], key, 0, False
                held_rows += len(group)
                if spilling or held_rows > group_rows:
                    large += [(int(key), x) for x in np.concatenate(held).tolist()]
                    held, spilling = [], True
                elif k != last:
                    if held_rows > 1:
                        links += _forest(np.concatenate(held), bits)
                    held, held_key, held_rows = [], None, 0
            if links or large:
                yield emit(links, large)
        if held and not spilling and held_rows > 1:
            yield emit(_forest(np.concatenate(held), bits), [])

    return run


def _variants(fp: Column, segments: int = 2) -> Column:
    """Keys of a fingerprint: each segment with one bit wiped out, with that bit's place."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        whole = (1 << (high - low)) - 1
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(whole).cast("long"))
        for bit in range(high - low):
            tag = F.lit((low + bit) << 32).cast("long")
            out.append(part.bitwiseAND(F.lit(whole ^ (1 << bit)).cast("long")).bitwiseOR(tag))
    return F.array(*out)


def _two_wiped(batches):
    """Keys of a fingerprint: all of it with two bits wiped out."""
    import pyarrow as pa

    low, high = np.triu_indices(64, 1)
    masks = ~((np.uint64(1) << low.astype(np.uint64)) | (np.uint64(1) << high.astype(np.uint64)))
    pair = (low * 64 + high).astype(np.int32)
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(values), 256):
            part = values[at : at + 256]
            keys = (part[:, None] & masks[None, :]).reshape(-1).view(np.int64)
            cols = [pa.array(np.tile(pair, len(part))), pa.array(keys), pa.array(np.repeat(part, len(masks)).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["pair", "key", "fp"])


def _met(keyed: DataFrame, bits: int, group_rows: int) -> DataFrame:
    """What rows (key, fp) of one key have to do with each other."""
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_index_links(bits, group_rows), "a long, b long, key long")


def links(nodes: DataFrame, group_rows: int = GROUP_ROWS, bits: int = 2) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` at ``bits`` (2 at most) or fewer bits apart."""
    met = durable(_met(nodes.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp"), bits, group_rows))
    near = met.where("b is not null").select("a", "b").distinct()
    large = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    wiped = large.mapInArrow(_two_wiped, "pair int, key long, fp long")
    close = lambda a, b: (b < a) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    groups = wiped.groupBy("pair", "key").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # four at most
    rest = groups.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda b: close(F.col("a"), b))).alias("b"))
    return near.union(rest).distinct()


def _shingles(text: Column, size: int) -> Column:
    """The distinct shingles of a text's words, as hashes; fewer words than a shingle make one."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = lambda w: F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(1)))
    # The words are put in a row of one, so that they are split once and not for every shingle.
    each = F.transform(F.array(words), lambda w: F.transform(starts(w), lambda _, i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))
    return F.array_distinct(F.get(each, F.lit(0)))


def similar(pairs: DataFrame, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts have shingle sets as similar as asked.

    Texts are read only for documents of a pair, and compared in the row.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = ends.join(texts, "node").select("node", _shingles(F.col("text"), size).alias("set"))
    sets = durable(sets.groupBy("node").agg(F.max("set").alias("set")))  # rows may be repeated under one id
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    few, many = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((100 * few >= percent * many) & (100 * common >= percent * (few + many - common))).select("a", "b")


def near_duplicates(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    marked = durable(fingerprints(docs))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, group_rows))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = durable(placed.join(least, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_fp, "fp").select("doc_id", hexed, "component_id")


def _cuts(bits: int, kept: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: as many more than ``kept`` as bits may differ."""
    ends = [64 * i // (bits + kept) for i in range(bits + kept + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def kept_segments(bits: int, nodes: int) -> int:
    """How many segments a key keeps: what asks for least work at this number of fingerprints.

    More segments make more keys a fingerprint (a microsecond or two each) and
    smaller groups (a nanosecond a comparison). What is found is the same.
    """

    def work(kept: int) -> float:
        group = nodes / 2 ** (64 * kept / (bits + kept))
        return math.comb(bits + kept, kept) * (2.0 + group / 2000)

    return min(range(2, 7), key=work)


def _by_segments(nodes: DataFrame, bits: int, kept: int) -> DataFrame:
    """Rows (key, node, fp, root) of each fingerprint under each choice of ``kept`` segments, the others wiped out.

    The number of the choice is in the key's upper bits.
    """
    cuts = _cuts(bits, kept)
    choices = list(combinations(range(len(cuts)), kept))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = part.column("fp").to_numpy().view(np.uint64)
                parts = [(fps >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in cuts]
                keys = np.empty((len(choices), len(fps)), np.int64)
                for number, chosen in enumerate(choices):
                    key, place = np.full(len(fps), number << 48, np.uint64), 0
                    for i in chosen:
                        key |= parts[i] << np.uint64(place)
                        place += cuts[i][1]
                    keys[number] = key.view(np.int64)
                many = np.tile(np.arange(len(fps)), len(choices))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(part.column(c).take(pa.array(many)) for c in ("node", "fp", "root"))], names=["key", "node", "fp", "root"])

    return nodes.select("node", "fp", "root").mapInArrow(run, "key long, node long, fp long, root long")


def _whole_groups(batches, columns: int):
    """(keys, rows) for rows of longs sorted by their first column: pieces that hold every group whole."""
    held, held_key = [], None  # the last group so far, which may go on
    for batch in batches:
        table = np.column_stack([batch.column(i).to_numpy() for i in range(columns)])
        if not len(table):
            continue
        if not held or table[-1, 0] != held_key:
            done = int(np.flatnonzero(table[:, 0] == table[-1, 0])[0])
            piece = np.concatenate([*held, table[:done]]) if held else table[:done]
            if len(piece):
                yield piece[:, 0], piece[:, 1:]
            held, held_key, table = [], table[-1, 0], table[done:]
        held.append(table)
    if held:
        piece = np.concatenate(held)
        yield piece[:, 0], piece[:, 1:]


def _leaders(bits: int):
    """For rows (key, node, fp, root) in key order: pairs (a < b) of nodes with the first node of a key's group, where close to it and of another root."""

    def run(batches):
        import pyarrow as pa

        key, leader, mark, of = None, 0, 0, 0
        for batch in batches:
            keys, nodes, fps, roots = (batch.column(i).to_numpy() for i in range(4))
            if not len(keys):
                continue
            first = np.r_[True, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            lead, marks, others = nodes[start], fps[start], roots[start]
            if keys[0] == key:
                lead[start == 0], marks[start == 0], others[start == 0] = leader, mark, of
            key, leader, mark, of = keys[-1], lead[-1], marks[-1], others[-1]
            near = (roots != others) & (np.bitwise_count((fps ^ marks).view(np.uint64)) <= bits)
            a, b = nodes[near], lead[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _segments(bits: int) -> int:
    """So many segments that one of them differs in at most one bit."""
    return max(2, bits // 2 + 1)


def _first_variant(bits: int):
    """For differences of pairs: the place of the first bit with whose wiping out a segment is equal."""
    cuts = _cuts(_segments(bits) - 1, 1)

    def first(apart: np.ndarray) -> np.ndarray:
        out = np.full(len(apart), -1)
        for low, width in reversed(cuts):
            part = (apart >> np.uint64(low)) & np.uint64((1 << width) - 1)
            place = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1)))
            out = np.where(np.bitwise_count(part) <= 1, low + place, out)
        return out

    return first


def _first_choice(bits: int, kept: int):
    """For differences of pairs: the number of the first choice of ``kept`` segments that are equal."""
    lows = [a for a, _ in _cuts(bits, kept)]
    numbers = {c: i for i, c in enumerate(combinations(range(bits + kept), kept))}

    def first(apart: np.ndarray) -> np.ndarray:
        equal = np.add.reduceat(np.unpackbits(apart.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1], lows, axis=1) == 0
        return np.array([numbers[tuple(np.flatnonzero(e)[:kept].tolist())] for e in equal], np.int64)

    return first


def _close_pairs(bits: int, first, upper: int, group_rows: int | None):
    """For rows (key, node, fp, root) in key order: pairs (a, b) of close nodes with different roots.

    A pair is told only under the ``first`` key that both share, whose number is
    in a key's bits from ``upper`` on. Rows of a group of more than ``group_rows``
    are passed on in the other columns.
    """

    def pairs(numbers, a, b):
        """Of rows side by side those that are close, in different components so far, and told here."""
        apart = a[:, 1].view(np.uint64) ^ b[:, 1].view(np.uint64)
        near = np.flatnonzero((np.bitwise_count(apart) <= bits) & (a[:, 2] != b[:, 2]))
        near = near[first(apart[near]) == numbers[near]] if len(near) else near
        return np.minimum(a[near, 0], b[near, 0]), np.maximum(a[near, 0], b[near, 0])

    def small(keys, rows, sizes):
        """Pairs of groups of few rows: all rows with the next of their group, with the one after it and so on."""
        left = np.repeat(sizes, sizes) - 1 - (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes))  # rows after this one
        for step in range(1, int(sizes.max(initial=1))):
            at = np.flatnonzero(left >= step)
            yield pairs(keys[at] >> upper, rows[at], rows[at + step])

    def large(key, rows):
        nodes, fps, roots = rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64), rows[:, 2]
        for at in range(0, len(rows), 256):
            apart = fps[at : at + 256, None] ^ fps[None, at:]
            near = (np.bitwise_count(apart) <= bits) & (roots[at : at + 256, None] != roots[None, at:])
            i, j = np.nonzero(np.triu(near, 1))
            if len(i):
                mine = first(apart[i, j]) == key >> upper
                a, b = nodes[at + i[mine]], nodes[at + j[mine]]
                yield np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        import pyarrow as pa

        def record(found, passed):
            n, m = sum(len(a) for a, _ in found), sum(len(r) for _, r in passed)
            ends = [np.concatenate([f[c] for f in found]) if n else np.zeros(0, np.int64) for c in (0, 1)]
            others = [np.concatenate([np.full(len(r), k) for k, r in passed]), *np.concatenate([r for _, r in passed]).T] if m else [np.zeros(0, np.int64)] * 4
            cols = [pa.concat_arrays([pa.array(p, pa.int64()), pa.nulls(m, pa.int64())]) for p in ends]
            cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(o, pa.int64())]) for o in others]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "node", "fp", "root"])

        for keys, rows in _whole_groups(batches, 4):
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            sizes, most = np.diff(edges), min(group_rows or FEW_ROWS, FEW_ROWS)
            few = np.repeat((sizes > 1) & (sizes <= most), sizes)
            found, passed, held = list(small(keys[few], rows[few], sizes[(sizes > 1) & (sizes <= most)])), [], 0
            for k in np.flatnonzero(sizes > most).tolist():
                key, group = int(keys[edges[k]]), rows[edges[k] : edges[k + 1]]
                if (group[:, 2] == group[0, 2]).all():
                    continue
                if group_rows and len(group) > group_rows:
                    passed.append((key, group))
                    continue
                for pair in large(key, group):
                    found.append(pair)
                    held += len(pair[0])
                    if held >= 1 << 16:
                        yield record(found, passed)
                        found, passed, held = [], [], 0
            if passed or any(len(a) for a, _ in found):
                yield record(found, passed)

    return run


_MET = "a long, b long, key long, node long, fp long, root long"


def close_pairs(nodes: DataFrame, bits: int, kept: int | None = None, group_rows: int = 8 * GROUP_ROWS) -> DataFrame:
    """Every pair (a < b) of nodes (node, fp, root) with fingerprints up to ``bits`` apart and different roots.

    They meet on variants of segments with one bit wiped out or, with ``kept``,
    on choices of so many segments.
    """
    if kept is None:
        keyed = nodes.select(F.explode(_variants(F.col("fp"), _segments(bits))).alias("key"), "node", "fp", "root")
        first, upper = _first_variant(bits), 32
    else:
        keyed, first, upper = _by_segments(nodes, bits, kept), _first_choice(bits, kept), 48
    met = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_close_pairs(bits, first, upper, group_rows), _MET))
    # Of a large group every two parts meet in a task of their own.
    large = met.where("a is null").select("key", "node", "fp", "root")
    many = large.groupBy("key").agg(F.ceil(2 * F.count("*") / group_rows).cast("int").alias("many"))
    dealt = large.join(many, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    # The number of the variant or choice stays in the key's upper bits, which tell repeated pairs.
    body = F.pmod(F.xxhash64("key", "low", "high"), F.lit(1 << upper))
    dealt = dealt.select(F.shiftright("key", upper).alias("number"), body.alias("body"), "node", "fp", "root").select(F.shiftleft("number", upper).bitwiseOR(F.col("body")).alias("key"), "node", "fp", "root")
    rest = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_close_pairs(bits, first, upper, None), _MET)
    return met.where("a is not null").select("a", "b").union(rest.select("a", "b")).distinct()


def similar_links(nodes: DataFrame, docs: DataFrame, size: int = 5, percent: int = 80, bits: int = 5, kept: int | None = None, group_rows: int = 8 * GROUP_ROWS) -> DataFrame:
    """Links (a, b) that join all nodes (node, fp) whose fingerprints are up to ``bits`` apart and whose texts are similar.

    First nodes are checked against one node of the groups they meet it in, three
    times with other nodes, which joins most of a large group of copies without telling
    its pairs. Then all pairs are checked whose ends are in different components
    so far, met on variants with one bit wiped out (``close_pairs``; beyond
    ``VARIANT_BITS``, or with ``kept``, on whole segments). So no pair is left out,
    and the first steps change only the work.
    """
    if kept is None and bits > VARIANT_BITS:
        kept = kept_segments(bits, nodes.count())
    wide = 64 // 6
    keys = F.array(*(F.shiftrightunsigned("fp", wide * i).bitwiseAND(F.lit((1 << wide) - 1).cast("long")).bitwiseOR(F.lit(i << 48).cast("long")) for i in range(6)))
    placed, asked = nodes.select("node", "fp", F.col("node").alias("root")), None
    found = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for place in ("node", F.xxhash64("node"), F.xxhash64("node", F.lit(2))):
        led = placed.select(F.explode(keys).alias("key"), "node", "fp", "root").repartition("key").sortWithinPartitions("key", place)
        named = led.mapInArrow(_leaders(bits), "a long, b long").distinct()
        named = durable(named if asked is None else named.join(asked, ["a", "b"], "left_anti"))
        found = durable(found.union(similar(named, docs, size, percent)))
        asked = named if asked is None else durable(asked.union(named))
        roots = components(found)
        placed = durable(nodes.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")))
    rest = durable(close_pairs(placed, bits, kept, group_rows).join(asked, ["a", "b"], "left_anti"))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(similar(rest, docs, size, percent))


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, bits: int = 5, words: int = 3, kept: int | None = None, group_rows: int = 8 * GROUP_ROWS) -> DataFrame:
    """doc_id and component_id under links between documents whose texts are similar.

    Equal texts (in their lower-cased words) are linked, and texts with a Jaccard
    similarity of their sets of ``size``-word shingles of ``percent`` or more whose
    fingerprints, here of ``words``-word shingles, are up to ``bits`` apart.
    Documents without an id are left out.
    """
    marked = durable(fingerprints(docs.where("doc_id is not null"), words, whole=True))
    nodes = durable(marked.groupBy("fp", "same").agg(F.min("doc_id").alias("node")))
    roots = components(similar_links(nodes.select("node", "fp"), docs, size, percent, bits, kept, group_rows))
    placed = durable(nodes.join(roots, "node", "left").select("fp", "same", F.coalesce("root", "node").alias("component_id")))
    return marked.join(placed, ["fp", "same"]).select("doc_id", "component_id")
