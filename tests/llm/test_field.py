"""The conditional random field against enumeration, and on forms that its labelled table does not have."""

import itertools

import numpy as np
import pytest

from orograph.llm import personal_data
from orograph.llm.personal_data import LABELS


@pytest.fixture(scope="module")
def field(spark):
    return personal_data.fit(personal_data.labelled_table(spark))


def total(field, scores, labels):
    out = field.move[len(LABELS), labels[0]] + scores[0, labels[0]]
    return out + sum(field.move[a, b] + scores[i, b] for i, (a, b) in enumerate(itertools.pairwise(labels), 1))


def test_viterbi_equals_enumeration(field):
    draw = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        scores = draw.normal(size=(5, n, len(LABELS))) * 3
        for one, got in zip(scores, field.viterbi(scores).tolist(), strict=True):
            best = max(itertools.product(range(len(LABELS)), repeat=n), key=lambda y: total(field, one, y))
            assert got == list(best)


def test_training_follows_the_gradient_of_the_likelihood():
    table = [(["ddd", "dddd"], ["phone", "run"], ["B-phone", "I-phone"]), (["ddd"], [""], ["O"]), (["a@a", "dd"], ["", "run"], ["B-email", "O"])]

    def likelihood(f):
        out = 0.0
        for shapes, cues, labels in table:
            scores = f.score(shapes, cues)
            every = [total(f, scores, y) for y in itertools.product(range(len(LABELS)), repeat=len(shapes))]
            out += total(f, scores, [LABELS.index(x) for x in labels]) - np.logaddexp.reduce(every)
        return out / len(table) - 0.5e-3 * ((f.emit**2).sum() + (f.move**2).sum())

    assert likelihood(personal_data.Field(table, steps=1)) < likelihood(personal_data.Field(table, steps=20)) < likelihood(personal_data.Field(table, steps=150))
    # At the end no single weight can be moved for a better likelihood.
    fitted = personal_data.Field(table, steps=3000, rate=0.02)
    best = likelihood(fitted)
    draw = np.random.default_rng(0)
    for _ in range(40):
        w = (fitted.emit, fitted.move)[draw.integers(2)]
        at = tuple(draw.integers(n) for n in w.shape)
        for change in (0.05, -0.05):
            w[at] += change
            assert likelihood(fitted) <= best + 1e-4
            w[at] -= change


@pytest.mark.parametrize("text, want", [
    ("call (020) 7946-0958 today", ["(020) 7946-0958"]),
    ("phone: 030 1234 5678", ["030 1234 5678"]),
    ("card 4111_1111_1111_1111 ok", ["4111_1111_1111_1111"]),
    ("mail root@mailhost please", ["root@mailhost"]),
    ("on 2024-01-31 at 12:30 we sold 1234 items for 99.50", []),
    ("pages 100-120 of volume 12, 3rd edition", []),
    ("version 10.2.33 of 2023", []),
])
def test_forms_beside_the_labelled_ones(field, text, want):
    ((base, every),) = personal_data.Finder(field)([text])
    assert [text[a:b] for a, b, _ in every] == want and base == []


def test_long_words_and_cues_are_read_whole(field):
    find = personal_data.Finder(field)
    long = "1-a." * 100_000
    assert find([long + " phone (555) 123-4567"])[0][1] != []
    assert personal_data.shape("1-a." * 30) == "d-a." * 30
    ((_, every),) = find(["x" * 50 + "phone 17 555-123-4567"])
    assert personal_data.runs("y" * 100_000 + ":telephone 12")[0][0][2] == ""
