"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text with its dummy prefix is a row of words, each a white-space mark followed
by other characters; no piece of the model spans a word's start, so words merge
independently. All new words of a batch lie in one flat symbol array. A round
finds, per word, the smallest rank of an adjacent pair (a segmented minimum),
merges its occurrences from the left, and compacts the array; words with no
mergeable pair leave it. Rounds end when no word is left.

In a long word the minimum is that of a window around each pair. A pair is lost
only to a neighbour that becomes part of a better pair, and what grows towards it
from outside the window would be longer than any piece before it came near; so a
pair that is least in its window is merged as it would be in its turn, and the
number of rounds does not grow with the length of a word.

Where an extension of a piece may rank at least as high as the piece itself, or
where scores are tied, only the leftmost occurrence is merged in a round, so the
result is that of merging one pair at a time.

Cases: null text counts as empty, which has no ids. Characters outside the
vocabulary become byte pieces. Texts are never cut. Repeated rows are encoded
once each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import chunks

MARK = "▁"
#: Kinds of piece in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.int64(2**62)
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, raw[i : i + size]
            i += size
        else:
            size = {1: 8, 5: 4}[wire]
            yield number, raw[i : i + size]
            i += size


def _window_least(rank: np.ndarray, left: int, right: int) -> np.ndarray:
    """The least rank from ``left`` places before each place to ``right`` after it."""
    whole, span = left + right + 1, 1
    out = np.full(len(rank) + whole, _NONE)
    out[left : left + len(rank)] = rank
    while span < whole:
        step = min(span, whole - span)
        np.minimum(out[:-step], out[step:], out=out[:-step])
        span += step
    return out[: len(rank)]


class PieceModel:
    """A BPE model file: its pieces, and the table of pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kinds = {k for _, _, k in self.pieces}
        if trainer.get(3, 1) != 2 or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only BPE models with a dummy prefix and no normalisation are handled")
        if kinds & {USER, UNUSED} or BYTE not in kinds:
            raise ValueError("models need byte fallback, and no user-defined or unused pieces")
        ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece spans words")
        self.byte = [0] * 256
        for i, (p, _, k) in enumerate(self.pieces):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        # Symbols: pieces by their ids, then single characters that only occur inside pieces.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.width = np.int64(max(symbols.values()) + 1)
        by_score = sorted({s for _, s, k in self.pieces if k == NORMAL}, reverse=True)
        place = {s: r for r, s in enumerate(by_score)}
        rank = {p: place[self.pieces[i][1]] for p, i in ids.items()}
        seen: dict[int, int] = {}
        for p in ids:
            seen[rank[p]] = seen.get(rank[p], 0) + 1
        careful = {r for r, n in seen.items() if n > 1}
        table = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is None or right is None:
                    continue
                table[left * int(self.width) + right] = (rank[p], i)
                careful.update(rank[q] for q in (p[:k], p[k:]) if len(q) > 1 and rank[q] >= rank[p])
        # So far from a pair nothing can reach its symbols before it is merged itself, with room to spare.
        self.reach = 2 * max(map(len, ids))
        self.glued = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.merged = np.array([table[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.careful = np.zeros(len(by_score) + 1, bool)
        self.careful[list(careful)] = True
        top = max(ord(c) for c in symbols if len(c) == 1)
        self.of_char = np.full(top + 2, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; negative symbols never merge."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[(self.keys[at] != key) | (left < 0) | (right < 0)] = len(self.keys)
        return self.ranks[at], self.merged[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (any text that no piece of a neighbour reaches into)."""
        lengths = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.of_char[np.minimum(code, len(self.of_char) - 1)]
        symbol = np.where(symbol < 0, -1 - code, symbol)
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), _NONE, np.int64)
        into = np.zeros(len(symbol), np.int64)
        done_words, done_symbols = [], []

        def refresh(at: np.ndarray) -> None:
            at = at[at < len(symbol) - 1]
            same = word[at] == word[at + 1]
            rank[at], into[at] = _NONE, 0
            at = at[same]
            rank[at], into[at] = self._pairs(symbol[at], symbol[at + 1])

        refresh(np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            if done.any():
                keep = ~np.repeat(done, size)
                done_words.append(word[~keep])
                done_symbols.append(symbol[~keep])
                symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
                best, size = best[~done], size[~done]
                if not len(symbol):
                    break
            target, far = np.repeat(best, size), np.repeat(size > 4 * self.reach, size)
            if far.any():
                target[far] = _window_least(rank, self.reach, self.reach)[far]
            at = np.flatnonzero((rank == target) & (rank != _NONE))
            same = np.r_[False, word[at[1:]] == word[at[:-1]]]
            run = ~(same & np.r_[False, at[1:] == at[:-1] + 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            alone = ~same  # first of its word
            ready = (np.arange(len(at)) - start) % 2 == 0
            if far.any():
                long = far[at]
                alone[long] = (_window_least(rank, self.reach, -1)[at] > rank[at])[long]
                # A run whose left part is not at its turn waits for it.
                ready &= ~((at > 0) & (rank[at - 1] == rank[at]) & (word[at - 1] == word[at]))[start]
            at = at[np.where(self.careful[rank[at]], alone, ready)]
            symbol[at] = into[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
            at = at - np.arange(len(at))
            rank[at[at == len(symbol) - 1]] = _NONE
            stale = np.zeros(len(symbol), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            refresh(np.flatnonzero(stale))
        if not done_words:
            return [[] for _ in words]
        word, symbol = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat = symbol.tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        last = len(self.pieces)
        for k in np.unique(word[(symbol < 0) | (symbol >= last)]).tolist():
            out[k] = [j for i, c in self._spelt(out[k], words[k]) for j in ([i] if 0 <= i < last else [self.byte[b] for b in c.encode()])]
        return out

    def _spelt(self, ids: list[int], word: str):
        """Ids with the part of the word each stands for."""
        at = 0
        for i in ids:
            n = len(self.pieces[i][0]) if 0 <= i < len(self.pieces) else 1
            yield i, word[at : at + n]
            at += n

    def cut(self, word: str) -> list[str]:
        """Parts of a word that merge independently: no piece holds the two characters at a cut."""
        if word[1:].isalpha():
            return [word]
        glued = self.glued
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in glued]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, marks not yet turned to spaces; byte pieces are joined first."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i][0] for i in ids])
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i][0].encode() for i in ids)
        return raw.decode("utf-8", "replace")


def _marked(text: str) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return _RUNS.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


class Codec:
    """Encodes and decodes batches of texts, with a bounded memo of words."""

    def __init__(self, path: str, memo: int = 500_000) -> None:
        self.model, self.limit = PieceModel(path), memo
        self.known: dict[str, tuple[str, str]] = {}  # of words
        self.parts: dict[str, tuple[str, str]] = {}
        self.names = [str(i) for i in range(len(self.model.pieces))]

    def learn(self, rows: list[list[str]]) -> dict[str, tuple[str, str]]:
        """Ids (as text) and decoded text of every word in the rows."""
        if len(self.known) > self.limit:
            self.known = {}
        if len(self.parts) > self.limit:
            self.parts = {}
        model, names, parts = self.model, self.names, self.parts
        new = list(set().union(*rows).difference(self.known))
        cuts = [model.cut(w) for w in new]
        fresh = list({p for c in cuts for p in c}.difference(parts))
        for part, ids in zip(fresh, model.encode_words(fresh), strict=True):
            parts[part] = (",".join([names[i] for i in ids]), model.decode_ids(ids))
        for word, c in zip(new, cuts, strict=True):
            if len(c) == 1:
                self.known[word] = parts[word]
            else:
                found = [parts[p] for p in c]
                self.known[word] = (",".join([f[0] for f in found]), "".join([f[1] for f in found]))
        return self.known

    def __call__(self, texts: list[str]):
        """(ids joined by commas, decoded text) of each text."""
        rows = [_marked(t) for t in texts]
        get = self.learn(rows).__getitem__
        for row in rows:
            found = list(map(get, row))
            yield ",".join([f[0] for f in found]), "".join([f[1] for f in found])[1:].replace(MARK, " ")


def encoded(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document; with ``digests`` their hashes instead.

    Returns doc_id, n_tokens and either ids (array of int) and decoded, or
    ids_sha256 and decoded_sha256.
    """

    def run(batches):
        import pyarrow as pa

        codec = Codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            texts = [t or "" for t in texts.to_pylist()]
            for a, b in chunks(texts):
                ids, back = zip(*codec(texts[a:b]), strict=True)
                n = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
                if digests:
                    yield pa.RecordBatch.from_arrays([docs_[a:b], n, pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([docs_[a:b], n, lists, pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
