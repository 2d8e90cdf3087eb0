"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most ``max_tokens`` ids; pieces are placed by
vector best-fit: a sequence has three residual capacities (tokens, documents,
attention cost, the sum of squared piece lengths), and a piece goes to the open
sequence that can take it under every capacity and whose weighted residual norm
(or weighted dot product of demand and residual) is best.

Scale: tokenising is one narrow pass. Only rows of a few numbers are shuffled,
to blocks of about ``block_rows`` pieces drawn by a seeded random number, so that
no task holds much more than a block whatever the input's size or skew (rows
repeated under one id are dealt like any others); each block leaves at most a few
sequences part empty.

Under the capacities of ``Capacity`` tokens bind first, and the dot product of
demand and residual chooses: it puts nine tenths of the pieces shorter than a
sequence elsewhere than scalar best fit would, for 0.02 % more sequences.

Cases: null text counts as empty, and an empty document is the end id alone.
Equal lengths are placed in (doc_id, piece) order. Repeated rows are packed as
often as they occur. Other columns, whatever their names, are ignored. An empty
table gives no rows. A null doc_id stays null. Texts are tokenised whole however
long they are; ties in the choice go to the sequence opened first.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class TextIds:
    """Token ids of texts as arrays, equal to those of the tokenizers library.

    Byte-level vocabularies whose ids are in merge order are run by a faster
    library on the same vocabulary; other files, and texts that name an added
    token, go through the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return
        alphabet = _byte_alphabet()
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        by_rank = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if by_rank == sorted(by_rank) and all(c in alphabet for t in vocab for c in t):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or (self.added and self.added.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece, with its place in its document.

    Only documents of more than ``max_tokens`` ids are cut; their last pieces
    are full and the first takes the remainder. ``keep_ids`` adds the ids.
    """

    def run(batches):
        import pyarrow as pa

        encode = TextIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "").tobytes() + end
                n = len(raw) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n, max_tokens), n] if n > max_tokens else [0, n]
                for k in range(len(cuts) - 1):
                    part = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(cuts[k])
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            names = [k for k in out if k != "ids" or keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in names], names=names)

    schema = PIECES + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and the weight of each capacity in the choice."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 0.25)
    rule: str = "dot"  # or "norm"

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents, self.attention) < 1 or self.rule not in ("norm", "dot"):
            raise ValueError("capacities must be positive, and rule 'norm' or 'dot'")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest pieces placed first.

    A piece that no sequence could hold by itself raises ValueError.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    longest = int(lengths.max(initial=0))
    if longest > capacity.tokens or longest**2 > capacity.attention:
        raise ValueError(f"a piece of {longest} tokens fits no sequence")
    weight = np.array(capacity.weights)
    left = np.empty((3, n))  # residuals of the open sequences, as shares of the capacities
    names = np.empty(n, np.int64)
    opened = used = 0
    shortest = lengths.min(initial=1) / caps[0]
    slack = 1e-9
    for step, i in enumerate(np.argsort(-lengths, kind="stable")):
        size = int(lengths[i])
        need = np.array([size, 1, size * size]) / caps
        if step % 256 == 255:  # sequences that can take nothing more are closed
            keep = np.flatnonzero((left[0, :used] >= shortest - slack) & (left[1, :used] >= 1 / caps[1] - slack))
            left[:, : len(keep)], names[: len(keep)] = left[:, keep], names[keep]
            used = len(keep)
        rest = left[:, :used] - need[:, None]
        fits = np.flatnonzero(rest.min(axis=0) >= -slack) if used else ()
        if len(fits):
            if capacity.rule == "norm":
                score = weight @ np.square(rest[:, fits])
            else:
                score = -((weight * need) @ left[:, fits])
            k = int(fits[np.argmin(score)])
        else:
            k, left[:, used], names[used] = used, 1.0, opened
            opened, used = opened + 1, used + 1
        bins[i] = names[k]
        offsets[i] = round((1 - left[0, k]) * caps[0])
        left[:, k] -= need
    return bins, offsets


def pack(rows: DataFrame, capacity: Capacity | None = None, block_rows: int = 8_000, n_rows: int | None = None) -> DataFrame:
    """Place pieces: adds ``sequence_id`` and ``offset`` to the columns of a piece.

    ``n_rows`` is the expected number of pieces; it only sets how many blocks
    there are. Without it the rows are counted first.
    """
    capacity = capacity or Capacity()
    blocks = max(1, -(-(rows.count() if n_rows is None else n_rows) // block_rows))
    keyed = rows.withColumn("block", F.floor(F.rand(7) * blocks))  # so that repeated rows are dealt too

    def run(block):
        block = block.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(block["length"].to_numpy(), capacity)
        block["sequence_id"] = bins + (block["block"].to_numpy() << 32)
        block["offset"] = offsets
        return block.drop(columns="block")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return keyed.groupBy("block").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: Capacity | None = None) -> DataFrame:
    """Tokenise, cut and pack a documents table."""
    capacity = capacity or Capacity()
    size = F.octet_length(F.col("text").cast("string"))
    # Pieces, by the number of bytes that make a full one in most texts.
    n = docs.agg(F.count("*") + F.coalesce(F.sum(F.floor(size / (3 * capacity.tokens))), F.lit(0))).first()[0]
    return pack(pieces(docs, tokenizer, capacity.tokens), capacity, n_rows=n)
