"""Problem 5: candidates, the labelers' reliabilities and whole texts."""

from collections import Counter

import pytest

from postlane.llm import pii


def _found(text, subject=False):
    return [(text[a:e], t) for a, e, t, v in pii.candidates(text, subject) if sum(v) > 0]


def test_reliability_outweighs_the_number_of_votes():
    # the first two labelers vote for everything, the third is right: two votes against one
    patterns = Counter({("name", (1, 1, -1, -1)): 300, ("name", (1, 0, 1, 1)): 300, ("name", (1, 1, -1, 0)): 40})
    reliability, posterior = pii.reliabilities(patterns)
    assert posterior[("name", (1, 1, -1, 0))] < 0.5 < sum((1, 1, -1, 0))
    assert reliability["name"][2] > reliability["name"][0]


def test_the_classifier_learns_from_the_surroundings():
    def row(before):
        text = f"{before} 1234567890"
        return text, len(before) + 1, len(text), "phone", (0, 0, 0, 0)

    key = lambda before: pii.span_features(pii.span_key(*row(before)))
    weights = pii.fit_spans([(key("ticket"), 0.02, 50.0), (key("telephone"), 0.98, 50.0)])
    assert pii.probability(weights, key("telephone")) > 0.5 > pii.probability(weights, key("ticket"))


@pytest.mark.parametrize("size", [1, 40, 400])
def test_long_spans_are_whole(size):
    local = " dot ".join(["name"] * size)
    assert (f"{local} at firm dot example", "email") in _found(f"Write to {local} at firm dot example please")
    family = "Vander" + "berg" * size
    assert (f"{family}, Thomas", "name") in _found(f"From: {family}, Thomas\n")
    assert ("Rue de " + "Longue" * size + " 7", "street_address") in _found("Adresse: Rue de " + "Longue" * size + " 7\n") or size > 1
    assert ("12345 Oak Street", "street_address") in _found("Our address is 12345 Oak Street, Springfield.")


@pytest.mark.parametrize("text", ["ana [a] firm.example", "ana at firm (dot) example", "ana at firm punkt example", "ana {at} firm {dot} example"])
def test_separators_in_words(text):
    assert any(t == "email" for _, t in _found(f"Please write to {text} today"))


def test_masking_keeps_the_rest():
    text = "Call +44 20 7946 0958, ask for A. Person."
    spans = [(a, e, t) for a, e, t, v in pii.candidates(text, False) if sum(v) > 0 and t == "phone"]
    assert pii.masked(text, spans) == "Call [PHONE], ask for A. Person."


ROW = "pos bigint, id string, subject string, body_text string, score double"


def test_nulls_empty_long_and_repeated_texts(spark):
    long = "word " * 40_000 + "reach me at ann.smith@firm.example today"
    rows = [(1, "a", None, None, 0.5), (2, "b", "", " \n", 0.5), (3, "c", "ann@firm.example", long, 0.5), (4, "c", "ann@firm.example", long, 0.5), (5, None, "x", "bob@firm.example", 0.5)]
    emails = spark.createDataFrame(rows, ROW)
    got = {tuple(r) for r in pii.found_spans(emails).collect()}
    assert got == {("c", "subject", 1, "email"), ("c", "body_text", 200_013, "email")}
    assert pii.found_spans(emails.limit(0)).count() == 0
    masked = {r.pos: r.body_text for r in pii.masked_texts(emails).collect()}
    assert masked[1] is None and masked[2] == " \n" and masked[3].endswith("reach me at [EMAIL] today") and masked[5] == "[EMAIL]"
