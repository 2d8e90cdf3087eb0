"""Personal data in long runs of numbers."""

import pytest

from orograph.llm import personal_data


@pytest.fixture(scope="module")
def field(spark):
    return personal_data.fit(personal_data.labelled_table(spark))


@pytest.mark.parametrize("before", [3, 62, 63, 64, 127, 1023, 3000])
def test_an_entity_at_any_place_of_a_run(field, before):
    text = "2024-01-31 " * before + "(555) 123-4567 " + "2024-01-31 " * 70
    ((base, every),) = personal_data.Finder(field)([text])
    assert base == [] and [text[a:b] for a, b, _ in every] == ["(555) 123-4567"]


@pytest.mark.parametrize("before", [3, 63, 64, 200])
def test_the_cue_holds_for_the_whole_run(field, before):
    text = "card " + "1234 " * before + "4111.1111.1111.1111 " + "1234 " * 70
    ((_, every),) = personal_data.Finder(field)([text])
    assert "4111.1111.1111.1111" in [text[a:b] for a, b, _ in every]


def test_a_long_run_is_decoded_as_in_a_batch(field):
    words = ["17", "(555)", "123-4567", "4111.1111.1111.1111", "2024-01-31", "jane@mailhost"] * 500
    shapes, cues = [personal_data.shape(w) for w in words], ["card"] + ["run"] * (len(words) - 1)
    whole = field.viterbi(field.score(shapes, cues)[None])[0].tolist()
    assert field.decode(shapes, cues) == field.decode(shapes, cues, 7) == whole
