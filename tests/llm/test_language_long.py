"""Cross parsing of long texts, large alphabets and letters beyond the first planes, against a plain parse."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from orograph.llm import language


def plain_costs(parser, sources, text):
    symbols = [0 if not language.letter(c) else parser.code.get(language.letter(c), 1) for c in text]
    symbols = [s for i, s in enumerate(symbols) if s or not i or symbols[i - 1]]
    out = []
    for k, name in enumerate(parser.languages):
        known = "".join(map(chr, parser._runs(sources[name])))
        coded = "".join(map(chr, symbols))
        count = at = 0
        while at < len(coded):
            size = 1
            while at + size < len(coded) and coded[at : at + size + 1] in known:
                size += 1
            count, at = count + 1, at + size
        out.append(count * parser.bits[k] / max(1, len(symbols)))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "".join(chr(0x4E00 + i) for i in range(500))])
@pytest.mark.parametrize("segment", [4, 512])
def test_phrases_cross_segments(letters, segment, monkeypatch):
    monkeypatch.setattr(language, "SEGMENT", segment)
    draw = random.Random(segment)
    make = lambda n: "".join(draw.choice(letters) if draw.random() < 0.9 else " " for _ in range(n))
    sources = {"x": make(3000), "y": make(2500), "z": "only latin words here"}
    parser = language.CrossParser(sources)
    points = parser.points()
    x = sources["x"]
    texts = [x, x[100:2900], x[:700] + sources["y"][5:1800] + x[50:60], *(make(n) for n in (511, 512, 513, 1023, 1025, 3000)), "a" * 2000, "", "q", x[3:9] * 300]
    _, costs = parser.costs(texts, points)
    for i, text in enumerate(texts):
        assert costs[i] == pytest.approx(plain_costs(parser, sources, text)), i


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "\U00020000\U00020001"), (2, "\U00020000 7"), (3, "\U0001F600 7")], "doc_id long, text string")
    parser = language.fit(spark.createDataFrame([("\U00020000\U00020001\U00020002", "han"), ("plain words", "en")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, parser).collect()} == {1: "han", 2: "han", 3: "und"}


def test_the_sample_does_not_depend_on_ids_or_copies(spark):
    rows = [(i, f"text number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}", "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = spark.createDataFrame([(1000 - i, t, k) for i, t, k in rows for _ in range(3)], "doc_id long, text string, lang string")
    a, b = (language.fit(d, sample_docs=20) for d in (docs, other))
    assert a.code == b.code and np.array_equal(a.table, b.table) and a.bits == b.bits


def test_a_language_known_only_from_long_texts_is_learnt(spark):
    rows = [(1, "the cat sat on the mat and the dog ran " * 700, "en"), (2, "le chat est sur le tapis et le chien court " * 3, "fr"), (3, "the dog sat and ran", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language.fit(docs)
    assert sorted(parser.languages) == ["en", "fr"]
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, parser).collect()}
    assert told == {1: "en", 2: "fr", 3: "en"}


def test_the_language_stage_without_labels_keeps_every_text_with_a_letter(spark, odd_docs):
    import corpus_pipeline

    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.known_language(spark, bare, None)
    assert got.columns == bare.columns
    want = sorted(repr(tuple(r)) for r in bare.collect() if any(ch.isalpha() for ch in r["text"] or ""))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    told = corpus_pipeline.known_language(spark, odd_docs, None)
    assert told.where("lang is null").isEmpty()
