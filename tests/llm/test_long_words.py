"""Very long words, against the library; and the vector's say in packing."""

import random
import string

import numpy as np
import pytest
import sentencepiece

from orograph.llm import packing, registry, sentence_pieces


@pytest.mark.parametrize("letters", ["ab", "lo", "aeinst", string.ascii_lowercase, "aA1.-", "日本語aé"])
def test_long_words_equal_the_library(letters):
    draw = random.Random(len(letters))
    library = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)
    codec = sentence_pieces.Codec(registry.PIECE_BPE)
    texts = ["".join(draw.choices(letters, k=n)) for n in (127, 128, 129, 130, 500, 3000)]
    texts += [texts[3][:37] * 60, "internationalization" * 40 + texts[4], letters[0] * 2001, texts[5] + " " + texts[4]]
    for text, (ids, back) in zip(texts, codec(texts), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and back == library.decode(want)


def test_a_word_of_a_million_letters_ends():
    draw = random.Random(1)
    codec = sentence_pieces.Codec(registry.PIECE_BPE)
    word = "".join(draw.choices(string.ascii_lowercase, k=1_000_000))
    ((ids, back),) = codec([word])
    assert back == word and ids.count(",") > 100_000


def test_the_vector_decides_at_little_cost():
    draw = np.random.default_rng(4)
    lengths = np.minimum(1024, draw.lognormal(5.5, 1.2, 8000).astype(int) + 1)
    ours, _ = packing.best_fit(lengths, packing.Capacity())
    scalar, _ = packing.best_fit(lengths, packing.Capacity(weights=(1.0, 0.0, 0.0), rule="norm"))
    least = -(-int(lengths.sum()) // 1024)
    assert ours.max() + 1 <= 1.002 * least + 1

    def mates(bins):
        out = {}
        for i, b in enumerate(bins.tolist()):
            out.setdefault(b, []).append(i)
        return {tuple(v) for v in out.values()}

    same = mates(ours) & mates(scalar)
    assert sum(map(len, same)) < 0.5 * len(lengths)
