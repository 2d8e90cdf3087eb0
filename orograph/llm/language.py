"""Language identification by cross-parsing entropy.

For each language, labelled text builds a suffix automaton. A text is parsed
against it from the left into longest matches: each phrase is the longest
string from here on that occurs in the language's text. The number of phrases,
times the logarithm of the length of the language's text, per letter read, is
the cross entropy; the language with the least of it wins.

The automata are fitted on a bounded sample: per language up to ``sample_docs``
different texts, those first in the order of a hash of the text, of ``max_chars``
characters at most each, until ``text_chars`` letters are reached. Prediction
reads every text whole, in numpy, all languages and many segments of ``SEGMENT``
characters at once. Each segment is first parsed from its start; then the phrase
that reaches into it from the segment before is followed until a phrase of both
parses begins at one place, from where they agree. So the phrases are those of a
parse of the whole text.

Letters (of all of Unicode) are lower-cased, each by itself, and everything else
is a single separator, so digits, marks and junk weigh little. The ``dense`` most
frequent letters have columns in a table of transitions, the others, as of large
alphabets, are looked up among the transitions that exist; letters that no
language has are one letter. The table takes about 20 MB a language.

Cases: null text, and text without a letter, is ``und`` with score 0. Where no
labelled text was found, every text is ``und``. Very short texts are scored as
they are. Ties go to the language first in the alphabet. Repeated rows are scored
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import chunks

SEGMENT = 512
UNKNOWN = "und"


def _automaton(code: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a coded text; the root is 0."""
    size = 2 * len(code) + 2
    link, length = [-1] * size, [0] * size
    count, last = 1, 0
    rows: list[dict[int, int]] = [{} for _ in range(size)]
    for c in code:
        new = count
        count += 1
        length[new] = length[last] + 1
        at = last
        while at >= 0 and c not in rows[at]:
            rows[at][c] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            to = rows[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = count
                count += 1
                length[copy], rows[copy], link[copy] = length[at] + 1, dict(rows[to]), link[to]
                while at >= 0 and rows[at].get(c) == to:
                    rows[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return rows[:count]


@lru_cache(200_000)
def letter(c: str) -> str:
    """The letter that a character counts as, empty for what is none."""
    return c.lower()[0] if c.isalpha() else ""


class CrossParser:
    """The automata of all languages in one table of transitions, and the coding of letters."""

    def __init__(self, texts: dict[str, str], dense: int = 62) -> None:
        self.languages = sorted(k for k, t in texts.items() if any(map(str.isalpha, t)))
        seen: dict[str, int] = {}
        for k in self.languages:
            for c in filter(None, map(letter, texts[k])):
                seen[c] = seen.get(c, 0) + 1
        ranked = sorted(seen, key=lambda c: (-seen[c], c))
        # 0: separator; 1: a letter that no language has; then letters by frequency.
        self.code = {c: i + 2 for i, c in enumerate(ranked)}
        self.width = min(len(ranked), dense) + 2
        self.symbols = len(ranked) + 2
        automata, self.bits, starts, base = [], [], [], 0
        for k in self.languages:
            coded = self._runs(texts[k])
            automata.append(_automaton(coded))
            starts.append(base)
            self.bits.append(math.log2(max(2, len(coded))))
            base += len(automata[-1])
        # A state is its row's place in the flat table. An entry is twice the next state, odd where a phrase
        # starts: at the root and at dead ends, with the symbol at hand.
        wide = self.width
        table = np.zeros((base, wide), np.int32 if 2 * base * wide < 2**31 else np.int64)
        rare: dict[int, int] = {}
        self.fresh = np.zeros((len(automata), self.symbols), np.int64)
        for k, (start, rows) in enumerate(zip(starts, automata, strict=True)):
            fresh = np.full(self.symbols, 2 * start * wide + 1, np.int64)
            for c, to in rows[0].items():
                fresh[c] = 2 * (to + start) * wide + 1
            self.fresh[k] = fresh
            part = table[start : start + len(rows)]
            part[:] = fresh[:wide]
            for i, row in enumerate(rows[1:], 1):
                for c, to in row.items():
                    if c < wide:
                        part[i, c] = 2 * (to + start) * wide
                    else:
                        rare[(start + i) * self.symbols + c] = 2 * (to + start) * wide
        self.table = table.reshape(-1)
        self.rare_keys = np.array(sorted(rare), np.int64)
        self.rare_to = np.array([rare[k] for k in self.rare_keys.tolist()] + [-1], np.int64)
        self.starts = np.array(starts, np.int64) * self.width
        self.bits = np.array(self.bits)

    def _runs(self, text: str) -> list[int]:
        out, gap = [], True
        for c in map(letter, text):
            if c:
                out.append(self.code.get(c, 1))
                gap = False
            elif not gap:
                out.append(0)
                gap = True
        return out

    def points(self) -> np.ndarray:
        """An empty table of the symbol of each code point, filled as they occur."""
        return np.full(0x110000, -1, np.int32)

    def coded(self, text: str, points: np.ndarray) -> np.ndarray:
        """The symbol of each character: 0 separator, 1 strange letter, 2 and up known letters."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = points[raw]
        if (code < 0).any():
            for p in np.unique(raw[code < 0]).tolist():
                c = letter(chr(p))
                points[p] = self.code.get(c, 1) if c else 0
            code = points[raw]
        return code

    def step(self, k: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The entry of each state and symbol, of arrays of one shape or that broadcast; ``k`` tells the language."""
        if self.symbols == self.width:
            return self.table[state + symbol]
        known = symbol < self.width
        got = self.table[state + np.where(known, symbol, 0)]
        if not known.all():
            k, state, symbol = np.broadcast_arrays(k, state, symbol)
            at = np.nonzero(symbol >= self.width)
            key = state[at] // self.width * self.symbols + symbol[at]
            place = np.searchsorted(self.rare_keys, key)
            place[place == len(self.rare_keys)] = 0
            hit = self.rare_keys[place] == key if len(self.rare_keys) else np.zeros(len(key), bool)
            got[at] = np.where(hit, self.rare_to[place], self.fresh[k[at], symbol[at]])
        return got

    def phrases(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each (text, language), for texts of the given sizes that lie one after another in ``code``."""
        many, first = len(self.languages), np.cumsum(sizes) - sizes
        parts = -(-sizes // SEGMENT)
        of_part = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(of_part)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(SEGMENT, sizes[of_part] - nth * SEGMENT)
        start = first[of_part] + nth * SEGMENT
        # Segments in order of length, so that those still being read are the first ones; ``next_`` finds a text's next segment.
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        next_ = np.full(len(order), -1)
        follows = np.flatnonzero(nth > 0)
        next_[place[follows - 1]] = place[follows]
        of_part, length, start = of_part[order], length[order], start[order]
        langs = np.arange(many)[:, None]
        end = np.repeat(self.starts[:, None], len(start), axis=1)
        count = np.zeros((many, len(start)), np.int64)
        begun = np.zeros((int(length.max(initial=0)), many, len(start)), bool)
        live = len(start)
        for i in range(len(begun)):
            while live and length[live - 1] <= i:
                live -= 1
            got = self.step(langs, end[:, :live], code[start[:live] + i][None])
            begun[i, :, :live] = got & 1
            count[:, :live] += got & 1
            end[:, :live] = got >> 1
        # Follow what reaches into a segment; where it changes the segment's end, follow that into the next one.
        fresh_end, fresh = end.copy(), count.copy()
        before = np.flatnonzero(next_ >= 0)
        ks, before = (x.reshape(-1) for x in np.broadcast_arrays(langs, before[None]))
        while len(ks):
            segments = next_[before]
            state, seen, passed = end[ks, before], np.zeros(len(ks), np.int64), np.zeros(len(ks), np.int64)
            open_, total, i = np.arange(len(ks)), np.zeros(len(ks), np.int64), 0
            last = fresh_end[ks, segments]
            while len(open_):
                at = segments[open_]
                got = self.step(ks[open_], state[open_], code[start[at] + i])
                own = begun[i, ks[open_], at]
                met = (got & 1 > 0) & own
                agreed = open_[met]
                total[agreed] = seen[agreed] + fresh[ks[agreed], segments[agreed]] - passed[agreed]
                seen[open_] += got & 1
                passed[open_] += own
                state[open_] = got >> 1
                i += 1
                over = ~met & (length[at] == i)
                ended = open_[over]
                total[ended] = seen[ended]
                last[ended] = state[ended]
                open_ = open_[~met & ~over]
            count[ks, segments] = total
            changed = last != end[ks, segments]
            ks, before = ks[changed], segments[changed]
            end[ks, before] = last[changed]
            on = next_[before] >= 0
            ks, before = ks[on], before[on]
        total = np.zeros((len(sizes), many))
        for j in range(many):
            total[:, j] = np.bincount(of_part, count[j], minlength=len(sizes))
        return total

    def costs(self, texts: list[str], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: letters read, and the cross entropy in each language."""
        code = self.coded("".join(texts), points)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        keep = np.ones(len(code), bool)  # runs of separators become one
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
        code, owner = code[keep], owner[keep]
        letters = np.bincount(owner[code != 0], minlength=len(texts))
        sizes = np.bincount(owner, minlength=len(texts))
        return letters, self.phrases(code, sizes) * self.bits / np.maximum(1, sizes)[:, None]


def fit(labelled: DataFrame, sample_docs: int = 200, text_chars: int = 40_000, max_chars: int = 20_000) -> CrossParser:
    """Automata of the languages of ``labelled`` (text, lang), from a bounded sample.

    The sample is at most ``sample_docs`` documents a language, longer ones by
    their first ``max_chars`` characters; so many and no more reach the driver.
    """
    rows = labelled.where("text is not null and lang is not null")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, max_chars).alias("text"), F.xxhash64("text").alias("place"))
    # Hashes are even, so the least of a language are those under a bound told by how many there are. Copies of a text are one.
    many = rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("many"))
    under = rows.join(F.broadcast(many), "lang").where(F.col("place") / 2.0**64 + 0.5 <= 2.0 * sample_docs / F.col("many"))  # one row a language
    few = under.groupBy("lang", "place").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    found = few.withColumn("nth", nth).where(F.col("nth") <= sample_docs)
    texts: dict[str, list[str]] = {}
    for row in found.orderBy("lang", "nth").toLocalIterator():
        got = texts.setdefault(row["lang"], [])
        if sum(map(len, got)) < text_chars:
            got.append(row["text"])
    return CrossParser({k: " ".join(v)[: text_chars + max_chars] for k, v in texts.items()})


def identify(docs: DataFrame, parser: CrossParser, keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """lang_pred and score (0 to 1, the lead over the second language) of every document.

    Returns doc_id, lang_pred and score; with ``keep`` all columns and these two,
    which ``names`` can call otherwise where a column of that name is there.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(parser)  # bounded by text_chars a language
    rows = docs if keep else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    columns = rows.columns
    place = columns.index("text")
    added = f"`{names[0]}` string, `{names[1]}` double"
    called = [*names]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if keep else "doc_id long"

    def run(batches):
        import pyarrow as pa

        parser = shared.value
        points = parser.points()
        told = np.array([*parser.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in chunks(texts, 4_000_000 // max(4, len(parser.languages))):
                letters, costs = parser.costs(texts[a:b], points)
                if parser.languages:
                    best = np.argmin(costs, axis=1)
                    ranked = np.sort(costs, axis=1)
                    lead = 1 - ranked[:, 0] / np.maximum(ranked[:, min(1, ranked.shape[1] - 1)], 1e-9)
                    best = np.where(letters > 0, best, len(told) - 1)
                    score = np.where(letters > 0, np.clip(lead, 0, 1), 0.0)
                else:
                    best, score = np.full(b - a, len(told) - 1), np.zeros(b - a)
                part = batch.slice(a, b - a)
                cols = [c for i, c in enumerate(part.columns) if keep or i != place]
                kept = [n for i, n in enumerate(columns) if keep or i != place]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(told[best].tolist(), pa.string()), pa.array(score)], names=[*kept, *called])

    return rows.mapInArrow(run, f"{fields}, {added}")


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
