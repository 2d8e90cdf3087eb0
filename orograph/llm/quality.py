"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects, and holds all the work it asks for (its
own split into words or lines, its own windows). Its cost (seconds on a sample)
and its selectivity (the share of the sample it rejects) are measured, and rules
run in the order of rejection per cost: a document that one rejects is not tried
against the rest, nor are their measures made for it, since they form one CASE.
The verdict is that of all rules together, so it does not depend on the measured
order. Rules of equal worth keep their given order.

All measures of a text are made from that text in its own row (arrays and
higher-order functions), so nothing is shuffled and no key is hot.

Cases: null and empty texts have no words and every measure 0; they fail the
length rule. Texts are read whole. Repeated rows are judged alike. Other columns
stay as they are.
An empty table gives no rows; on an empty sample rules keep their given order.
A three-word window is told by the 64-bit hash of its words.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import durable

#: The white space between words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda s: F.translate(s, SPACE, "") != "")


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, ""))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once in a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words of an array in three-word windows that occur twice or more in it."""

    def counted(hashes: Column) -> Column:
        # Windows sorted by hash, so that equal ones are neighbours.
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(w: Column) -> Column:
            equal = lambda g, j: F.coalesce(F.get(w, j)["h"] == g["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(w, lambda g, j: equal(g, j + 1) | equal(g, j - 1)), lambda g: g["i"]))

        reach = lambda at: F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3))))
        total = lambda at: F.aggregate(reach(at), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(windows, lambda w: _let(repeated(w), total)))

    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return _let(words, lambda w: _let(hashed(w), counted))


def measures(docs: DataFrame, prefix: str = "q_") -> DataFrame:
    """Adds to a table that has no column of the prefix: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, prefixed."""
    text, words, lines = text_of(), F.col(prefix + "words"), F.col(prefix + "lines")
    out = docs.withColumns({prefix + "words": words_of(text), prefix + "lines": lines_of(text)})
    out = out.withColumns({
        prefix + "n_words": F.size(words).cast("long"),
        prefix + "word_chars": word_chars(text).cast("long"),
        prefix + "n_symbols": n_symbols(text).cast("long"),
        prefix + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        prefix + "n_repeat_words": n_repeat_words(words),
    })
    return out.drop(prefix + "words", prefix + "lines")


@dataclass(frozen=True)
class Rule:
    """A condition on a document's text that rejects it, with all the work that it asks for."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    again = _let(words_of(text_of()), lambda w: 100 * n_repeat_words(w) > 50 * F.size(w))
    return [Rule("short", F.size(words_of(text_of())) < 50), Rule("repetitive", again)]


def more_rules() -> list[Rule]:
    """Rules beyond the base; clean prose is far from each threshold."""
    text = text_of()
    n = F.size(words_of(text))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    repeated = _let(lines_of(text), lambda s: 10 * (F.size(s) - F.size(F.array_distinct(s))) > 3 * F.greatest(F.size(s), F.lit(10)))
    return [
        Rule("symbols", 4 * n_symbols(text) > n),
        Rule("duplicate_lines", repeated),
        Rule("long_words", word_chars(text) > 20 * n),
        Rule("capitals", 2 * capitals > word_chars(text)),
    ]


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = 1_000, longest: int = 100_000, seed: int = 9) -> list[Rule]:
    """Rules by rejection per cost, both measured on a sample.

    The sample is at most ``sample_rows`` texts of at most ``longest`` characters;
    it is drawn from the few partitions that hold enough rows. A cost is the time
    that the rule's whole work takes there, less that of a job without work.
    """
    share = min(1.0, 50 * sample_rows / max(1, docs.count()))
    drawn = docs.select(F.col("text").cast("string")).sample(share, seed).where(F.coalesce(F.length("text"), F.lit(0)) <= longest).limit(sample_rows).collect()
    sample = durable(docs.sparkSession.createDataFrame(drawn, "text string"))

    def timed(condition: Column) -> tuple[float, float]:
        ask = sample.agg(F.count_if(condition).alias("hit"), F.count("*").alias("n"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            got = ask.first()
            took.append(time.perf_counter() - began)
        return got["hit"] / max(1, got["n"]), min(took)

    idle = timed(F.col("text").isNull())[1]
    worth = []
    for place, rule in enumerate(rules):
        share, took = timed(rule.rejects)
        worth.append((-share / max(took - idle, 1e-3), place))
    return [rules[p] for _, p in sorted(worth)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null where none does; later rules are not evaluated."""
    first, *rest = rules
    out = F.when(first.rejects, F.lit(first.name))
    for r in rest:
        out = out.when(r.rejects, F.lit(r.name))
    return out


def judged(docs: DataFrame, sample_rows: int = 1_000) -> DataFrame:
    """doc_id, the base measures, base_failed and kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = ordered(rows, more_rules(), sample_rows)
    n, again = F.col("q_n_words"), F.col("q_n_repeat_words")
    out = measures(rows).withColumn("base_failed", (n < 50) | (100 * again > 50 * n))
    # The case of the rules is evaluated only for rows that the base keeps.
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(chosen).isNull())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("q_" + n).alias(n) for n in names), "base_failed", kept.alias("kept"))


def accepted(docs: DataFrame, sample_rows: int = 1_000) -> DataFrame:
    """The rows of documents that no rule rejects, with their own columns."""
    return docs.where(cascade(ordered(docs, [*base_rules(), *more_rules()], sample_rows)).isNull())


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
             list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS lines
      FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) AS t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (4 * n_symbols > n_words OR 10 * n_dup_lines > 3 * greatest(n_lines, 10)
           OR word_chars > 20 * n_words OR 2 * length(regexp_replace(text, '\P{Lu}+', '', 'g')) > word_chars) AS kept
FROM b
"""
