"""Personal data: patterns for the plain forms, and a linear-chain conditional random field for the rest.

The patterns find emails, IP addresses, cards and phone numbers in their usual
form. The field labels words by their shapes and those of their neighbours, and
adds forms the patterns miss (phone numbers without a plus, cards with unusual
separators, addresses on hosts without a dot); what it adds passes the kind's
own check (digit counts, the Luhn sum) and overlaps nothing that a pattern found.

The field is trained here, by gradient ascent on the likelihood of a small
labelled table of words. Words without a digit, plus or at sign are outside any
entity by definition, so Viterbi decoding falls apart into short runs of the
other words, exactly; short runs are decoded in numpy batches of equal length,
longer ones whole and one by one.

Cases: null text counts as empty and has no spans. Texts are read whole; every
scan is linear. Spans are of code points, the end exclusive. Repeated rows are
scanned alike; other columns are ignored (redaction keeps them); an empty table
gives no rows. Of equally good labels Viterbi takes those first in ``LABELS``. A
word's shape and the word before a run are read in full however long they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import parts

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its run of digits does, so later starts need no try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the weighted digit sum is a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    n = len(d := _digits(s))
    return 12 <= n <= 19 and luhn(d) if kind == "card" else 9 <= n <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the patterns find, by start and then kind."""
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(*m.span(), kind) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_TRIGGER = re.compile(r"[0-9@+]")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
#: Words that announce a kind.
CUES = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "telefon": "phone", "card": "card", "visa": "card", "carte": "card", "tarjeta": "card", "karte": "card", "mail": "email", "email": "email", "contact": "email", "ip": "ip", "server": "ip"}


def shape(word: str) -> str:
    """Letters as one a, digits as a d each up to four and then their rough number; other characters as they are."""
    out, i = [], 0
    while i < len(word):
        c, j = word[i], i
        if "0" <= c <= "9":
            while j < len(word) and "0" <= word[j] <= "9":
                j += 1
            n = j - i
            out.append("d" * n if n <= 4 else "5+" if n < 9 else "9+" if n < 12 else "12+" if n < 20 else "20+")
        elif c.isalpha():
            while j < len(word) and word[j].isalpha():
                j += 1
            out.append("a")
        else:
            out.append(c)
            j = i + 1
        i = j
    return "".join(out)


def runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring words with a trigger: (start, end, cue before the run's word)."""
    out: list[list[tuple[int, int, str]]] = []
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] not in _SPACE:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        gap = start
        while gap > done and text[gap - 1] in _SPACE:
            gap -= 1
        if out and gap == done and start - gap <= 2:
            out[-1].append((start, end, "run"))
        else:
            word = gap
            while word > done and text[word - 1] not in _SPACE:
                word -= 1
            out.append([(start, end, CUES.get(text[word:gap].lower().strip(".,:;()"), "") if start - gap <= 2 else "")])
        done = end
    return out


def cue_of(cues: list[str]) -> str:
    """The cue of a run: the first that one of its words has."""
    return next((c for c in cues if c and c != "run"), "")


def features(shapes: list[str], first: str, i: int) -> list[str]:
    """Names of the features of word i of a run with the cue ``first``."""
    before = shapes[i - 1] if i else "^"
    after = shapes[i + 1] if i + 1 < len(shapes) else "$"
    digits = sum(c == "d" for c in shapes[i])
    return [f"s={shapes[i]}", f"p={before}", f"n={after}", f"sp={before}|{shapes[i]}", f"sn={shapes[i]}|{after}", f"cue={first}", f"cs={first}|{shapes[i]}", f"d={min(digits, 9)}", "at" if "@" in shapes[i] else "no", "bias"]


class Field:
    """A linear-chain conditional random field."""

    def __init__(self, table: list[tuple[list[str], list[str], list[str]]], steps: int = 150, rate: float = 0.15, l2: float = 1e-3) -> None:
        """``table``: (shapes, cues, labels) of each labelled run."""
        names = sorted({f for s, c, _ in table for i in range(len(s)) for f in features(s, cue_of(c), i)})
        self.index = {f: i for i, f in enumerate(names)}
        k, n, t = len(LABELS), len(table), max(len(s) for s, _, _ in table)
        found: list[tuple[int, int, int]] = []  # (run, word, feature)
        gold, size = np.zeros((n, t), np.int64), np.array([len(s) for s, _, _ in table])
        for r, (s, c, labels) in enumerate(table):
            for i in range(len(s)):
                found += [(r, i, self.index[f]) for f in features(s, cue_of(c), i)]
                gold[r, i] = LABELS.index(labels[i])
        inside = np.arange(t)[None] < size[:, None]
        emit, move = np.zeros((len(names), k)), np.zeros((k + 1, k))  # the last row of moves: from the start
        # Features in order of their words for scores, and in their own order for slopes; every word and feature occurs.
        run_of, word_of, feature = np.array(found).T
        place = run_of * t + word_of
        first_of_word = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        by_feature = np.argsort(feature, kind="stable")
        first_of_feature = np.flatnonzero(np.r_[True, np.diff(feature[by_feature]) > 0])
        words = place[first_of_word]

        def summed(node: np.ndarray) -> np.ndarray:
            return np.add.reduceat(node.reshape(n * t, k)[place[by_feature]], first_of_feature)

        want_emit = summed(np.eye(k)[gold])
        want_move = np.zeros((k + 1, k))
        np.add.at(want_move, (np.full(n, k), gold[:, 0]), 1)
        for i in range(1, t):
            on = inside[:, i]
            np.add.at(want_move, (gold[on, i - 1], gold[on, i]), 1)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
        for step in range(1, steps + 1):
            score = np.zeros((n * t, k))
            score[words] = np.add.reduceat(emit[feature], first_of_word)
            score = score.reshape(n, t, k)
            alpha = np.zeros((n, t, k))
            beta = np.zeros((n, t, k))
            alpha[:, 0] = score[:, 0] + move[k]
            for i in range(1, t):
                nxt = np.logaddexp.reduce(alpha[:, i - 1, :, None] + move[None, :k], axis=1) + score[:, i]
                alpha[:, i] = np.where(inside[:, i, None], nxt, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                nxt = np.logaddexp.reduce(move[None, :k] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                beta[:, i] = np.where(inside[:, i + 1, None], nxt, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
            got_move = np.zeros((k + 1, k))
            got_move[k] = node[:, 0].sum(0)
            for i in range(1, t):
                pair = np.exp(alpha[:, i - 1, :, None] + move[None, :k] + (score[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
                got_move[:k] += (pair * inside[:, i, None, None]).sum(0)
            slopes = [(want_emit - summed(node)) / n - l2 * emit, (want_move - got_move) / n - l2 * move]
            for w, g, (m, v) in zip((emit, move), slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.emit, self.move = emit, move

    def score(self, shapes: list[str], cues: list[str], start: int = 0, end: int | None = None) -> np.ndarray:
        """Emission scores of the words of a run, or of those from ``start`` to ``end``."""
        first = cue_of(cues)
        return np.array([self.emit[[j for f in features(shapes, first, i) if (j := self.index.get(f)) is not None]].sum(0) for i in range(start, len(shapes) if end is None else min(end, len(shapes)))])

    def decode(self, shapes: list[str], cues: list[str], part: int = 1024) -> list[int]:
        """Best labels of one run of any length: words are scored in parts, and only the steps back are kept."""
        k, best = len(LABELS), None
        back = np.zeros((len(shapes), k), np.int8)
        for at in range(0, len(shapes), part):
            for i, score in enumerate(self.score(shapes, cues, at, at + part), at):
                if best is None:
                    best = score + self.move[k]
                else:
                    step = best[:, None] + self.move[:k]
                    back[i] = step.argmax(0)
                    best = step.max(0) + score
        out = [int(best.argmax())]
        for i in range(len(shapes) - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of runs of one length: (runs, words, labels) to (runs, words)."""
        n, t, k = scores.shape
        best = scores[:, 0] + self.move[k]
        back = np.zeros((n, t, k), np.int64)
        for i in range(1, t):
            step = best[:, :, None] + self.move[None, :k]
            back[:, i] = step.argmax(1)
            best = step.max(1) + scores[:, i]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        return out


def labelled_words(seed: int = 5, copies: int = 12) -> list[tuple[int, int, str, str, str]]:
    """The small labelled table: (run, position, word, cue, label), made from forms by a seeded draw."""
    draw = random.Random(seed)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    name = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8)))
    forms = [  # (kind, cue, words)
        ("phone", "", lambda: [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"]),
        ("phone", "phone", lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"]),
        ("phone", "", lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"]),
        ("phone", "phone", lambda: [f"{d(3)}-{d(3)}-{d(4)}"]),
        ("phone", "phone", lambda: [f"{d(3)}.{d(3)}.{d(4)}"]),
        ("phone", "phone", lambda: [d(3), d(3), d(4)]),
        ("phone", "phone", lambda: [d(4), d(7)]),
        ("phone", "", lambda: [f"+{d(2)}", d(2), d(4), d(4)]),
        ("phone", "phone", lambda: [f"{d(4)}-{d(7)}"]),
        ("phone", "phone", lambda: [f"{d(3)}-{d(8)}"]),
        ("phone", "phone", lambda: [f"({d(4)})", d(7)]),
        ("phone", "phone", lambda: [d(2), d(2), d(2), d(2), d(2)]),
        ("phone", "phone", lambda: [d(10)]),
        ("card", "", lambda: [d(16)]),
        ("card", "", lambda: [d(4), d(4), d(4), d(4)]),
        ("card", "", lambda: ["-".join(d(4) for _ in range(4))]),
        ("card", "card", lambda: [".".join(d(4) for _ in range(4))]),
        ("card", "card", lambda: ["_".join(d(4) for _ in range(4))]),
        ("ip", "", lambda: [".".join(str(draw.randint(0, 255)) for _ in range(4))]),
        ("email", "", lambda: [f"{name()}.{d(2)}@{name()}{d(1)}.{name()}.com"]),
        ("email", "email", lambda: [f"{name()}@{name()}"]),
        ("email", "", lambda: [f"{name()}@{name()}.{name()}"]),
        (None, "", lambda: [d(draw.randint(1, 4))]),
        (None, "", lambda: [d(1) + "." + d(1)]),
        (None, "", lambda: [d(1) + "." + d(1) + "."]),
        (None, "", lambda: [d(1) + "." + d(1) + "." + d(2)]),
        (None, "", lambda: [f"{d(4)}-{d(2)}-{d(2)}"]),
        (None, "", lambda: [f"{d(2)}.{d(2)}.{d(4)}"]),
        (None, "", lambda: [f"{d(2)}:{d(2)}"]),
        (None, "", lambda: [f"{d(3)}-{d(3)}-{d(4)}"]),
        (None, "", lambda: [d(draw.randint(5, 11))]),
        (None, "", lambda: [d(20)]),
        (None, "", lambda: [f'"{d(3)}{name()}{d(4)}{name()}"']),
        (None, "", lambda: [d(3), d(3)]),
        (None, "", lambda: [d(2), d(2), d(2)]),
        (None, "", lambda: [f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"]),
        (None, "", lambda: [f"{d(2)}.{d(3)},{d(2)}"]),
        (None, "", lambda: [f"{d(4)}-{d(6)}"]),
        (None, "card", lambda: [f"{d(2)}/{d(2)}"]),
        (None, "", lambda: [f"@{name()}"]),
        (None, "", lambda: [f"({d(4)})"]),
        (None, "", lambda: [d(3), d(3), d(4)]),
        (None, "phone", lambda: [d(1)]),
        (None, "", lambda: [f"{d(2)}+"]),
        (None, "", lambda: ["+"]),
    ]
    out, run = [], 0
    others = [f for f in forms if f[0] is None and not f[1]]
    for copy in range(copies):
        for kind, cue, words in forms:
            words = words()
            tail = draw.choice(["", "", "", ",", "."]) if kind else ""
            labelled = [(w + tail * (i == len(words) - 1), "O" if kind is None else f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words)]
            if copy % 2:  # inside a longer run
                before, after = ([(w, "O") for w in draw.choice(others)[2]()] for _ in range(2))
                labelled = [*before, *labelled, *after]
            out += [(run, i, w, "run" if i else cue, label) for i, (w, label) in enumerate(labelled)]
            run += 1
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled words as a table."""
    return spark.createDataFrame(labelled_words(), "run int, position int, word string, cue string, label string")


def fit(table: DataFrame, max_words: int = 20_000) -> Field:
    """A field trained on a labelled table of words, of which at most ``max_words`` are read."""
    by_run: dict[int, list] = {}
    for r in table.orderBy("run", "position").limit(max_words).collect():
        by_run.setdefault(r["run"], []).append(r)
    return Field([([shape(r["word"]) for r in rows], [r["cue"] for r in rows], [r["label"] for r in rows]) for rows in by_run.values()])


_TRIM = ".,;:!?\"'|)]}>"


def _entity(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The span of a labelled run, trimmed and checked."""
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    while start < end and text[start] in "\"'<[{|":
        start += 1
    s = text[start:end]
    if kind == "email":
        ok = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+", s) is not None
    elif kind == "ip":
        ok = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None and _valid("ip", s)
    elif kind == "card":
        ok = re.fullmatch(r"[0-9](?:[\x20._-]?[0-9])+", s) is not None and _valid("card", s)
    else:
        ok = re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", s) is not None and _valid("phone", s)
    return (start, end, kind) if ok else None


#: Words of the longest runs that are decoded together with others of their length, and whose scores are kept.
TOGETHER = 64


class Finder:
    """Finds all spans of batches of texts."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.kept = lru_cache(100_000)(lambda shapes, cues: field.score(list(shapes), list(cues)))

    def score(self, shapes: list[str], cues: list[str]) -> np.ndarray:
        """Scores of a run, kept for the next like it unless its shapes are long."""
        return self.kept(tuple(shapes), tuple(cues)) if sum(map(len, shapes)) <= 400 else self.field.score(shapes, cues)

    def __call__(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        by_length: dict[int, list] = {}
        words = lambda k, run: [shape(texts[k][a:b].rstrip(".,;:!?")) for a, b, _ in run]
        cues = lambda run: [c for _, _, c in run]

        def take(k, run, labels):
            i = 0
            while i < len(run):
                label, j = LABELS[labels[i]], i + 1
                if label[0] == "B":
                    while j < len(run) and LABELS[labels[j]] == f"I-{label[2:]}":
                        j += 1
                    if span := _entity(texts[k], run[i][0], run[j - 1][1], label[2:]):
                        added[k].append(span)
                i = j

        for k, text in enumerate(texts):
            for run in runs(text):
                if len(run) <= TOGETHER:
                    by_length.setdefault(len(run), []).append((k, run))
                else:
                    take(k, run, self.field.decode(words(k, run), cues(run)))
        for found in by_length.values():
            scores = np.array([self.score(words(k, run), cues(run)) for k, run in found])
            for (k, run), labels in zip(found, self.field.viterbi(scores).tolist(), strict=True):
                take(k, run, labels)
        out = []
        for mine, more in zip(base, added, strict=True):
            taken = merged(mine)
            starts = [a for a, _, _ in taken]
            every = list(mine)
            for s in sorted(more):  # spans that are added lie apart, so only base spans can be in the way
                i = bisect_left(starts, s[1])
                if not i or taken[i - 1][1] <= s[0]:
                    every.append(s)
            out.append((mine, sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))))
        return out


def merged(spans: list[tuple[int, int, str]]) -> list[list]:
    """Spans in order, those that overlap as one of the first one's kind."""
    out: list[list] = []
    for a, b, k in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b, k])
    return out


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def found(docs: DataFrame, field: Field) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""

    def run(batches):
        import pyarrow as pa

        find = Finder(field)
        for batch in parts(batches, 1):
            results = find([t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[2] == k for s in mine) for mine, _ in results], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_told(mine).encode()).hexdigest() for mine, _ in results], pa.string())
            spans = pa.array([_told(every) for _, every in results], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for a, b, k in merged(spans):
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The same rows and columns with all spans of ``text`` replaced; null texts stay null."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        find = Finder(field)
        for batch in parts(batches, place):
            texts = batch.column(place).to_pylist()
            results = find([t or "" for t in texts])
            new = [t if not every else redact(t, every) for t, (_, every) in zip(texts, results, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
