"""Decontamination of copies in capitals, of items dense in placeholders, and of repeated values."""

from __future__ import annotations

import random

import numpy as np
import pytest

from driftline.llm import templates

FILLER = "wind over the low hills moved slowly through dry grass and nobody came along the road that day "
LONG = "In a small town Alice bought 12 apples for 30 dollars and gave Bob half of them before lunch on Monday morning"
DENSE = "Alice 12 Bob 15 Carol 19 Dan 23 Eve 29 Frank 31"
TITLE = "The Lord Of All Rings Was Never Seen In Any Old Northern Town"
REPEATED = "The baker sold 12 loaves before noon and kept 5 of them for the poor. The miller sold 12 sacks after noon and kept 5 of them for the market"


def found(spark, text, item):
    docs = spark.createDataFrame([(1, FILLER + text + " " + FILLER), (2, FILLER)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    return {r["doc_id"]: (r["coverage"], r["exact"]) for r in templates.contaminated(docs, bench).collect()}


@pytest.mark.parametrize("item", [LONG, DENSE, TITLE, "quiet harbour", "12 of 30"])
@pytest.mark.parametrize("case", [str, str.upper])
def test_copies_are_found_in_any_case(spark, item, case):
    assert found(spark, case(item), item) == {1: (1.0, True)}


def test_new_numbers_in_capitals_are_found(spark):
    assert found(spark, LONG.replace("12", "97").replace("30", "41").upper(), LONG)[1][1] is False


def test_other_values_in_a_dense_item_are_not_a_copy(spark):
    assert found(spark, "Gus 1 Hal 2 Ida 3 Jon 4 Kim 5 Leo 6", DENSE) == {}


@pytest.mark.parametrize(
    ("old", "new"), [("12 loaves", "13 loaves"), (". The miller", ". A miller"), ("kept 5 of them for the market", "kept 12 of them for the market")]
)
def test_a_repeated_value_that_changes_once_leaves_the_rest(spark, old, new):
    assert found(spark, REPEATED, REPEATED) == {1: (1.0, True)}
    got = found(spark, REPEATED.replace(old, new), REPEATED)
    assert got[1][0] >= 0.5 and not got[1][1]


def test_values_follow_the_mapping_of_most_windows():
    same, moved, other = (["12"], ["12"]), (["12"], ["13"]), (["12"], ["14"])
    assert templates.accepted([same, moved, moved, other]) == [True, True, True, False]
    assert templates.accepted([(["1"], ["9"]), (["2"], ["9"])]) == [True, True]  # numbers may fall together
    assert templates.accepted([(["Ann"], ["Eve"]), (["Ann"], ["Eve"]), (["Bob"], ["Eve"])]) == [True, True, False]


def test_words_at_once_are_the_words_one_by_one(monkeypatch):
    r = random.Random(1)
    letters = "éßÜ²ſ€’İЖ漢aB9'-.,:/%$ _\n\tz"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(5000)] + ["ﬁne Straße STRASSE 5 Kg"]
    at_once = [templates._words(t, templates._Words()) for t in texts]
    monkeypatch.setattr(templates, "AT_ONCE", -1)
    for text, quick in zip(texts, at_once, strict=True):
        plain = templates._words(text, templates._Words())
        assert all(np.array_equal(a, b) for a, b in zip(quick, plain, strict=True)) and len(plain[0]) == len(templates._TOKEN.findall(text))
