"""Problem 4: typos of given names, however large the table."""

from postlane.llm import entities


def _given(spark, rows):
    return {r.address: r.given for r in entities._person_rows(spark.createDataFrame(rows, entities.PARSED)).collect()}


def _row(address, first, second):
    return (address, 1, "person", first, second, False, [], address, "", "x")


def _surname(n):
    return "s" + "".join(chr(97 + n // 26**k % 26) for k in range(3))


def test_a_typo_with_many_surnames_is_repaired(spark):
    rows = [_row(f"g{n}", "gregory", _surname(n)) for n in range(46)] + [_row(f"t{n}", "gregoory", _surname(n)) for n in range(6)]
    rows += [_row(f"u{n}", "gregora", _surname(n)) for n in range(40)] + [_row("one", "ursuula", "smith")]
    got = _given(spark, rows)
    assert {got[f"t{n}"] for n in range(6)} == {"gregory"}  # six surnames against 46
    assert got["u0"] == "gregora"  # about as common as its neighbour
    assert got["one"] == "ursula"  # a listed name is known without being seen


MAIL = "sender_email string, sender_name string, recipient_email string, recipient_name string, entity string"


def _entities(spark, rows):
    df = spark.createDataFrame([(a, n, None, None, "clash") for a, n in rows], MAIL)
    return df, {r.address: r.entity for r in entities.entities(df).collect()}


def test_a_merged_profile_matches_again(spark):
    """No block holds one@x and three@x until two@x, known by initials alone, has joined one@x and brought its second surname."""
    rows = [("one@x.com", "Thomas Kesler"), ("two@x.com", "T. Kesler"), ("two@x.com", "T. Brandt"), ("three@x.com", "Thomas Brandt"), ("four@x.com", "Timothy Brandt")]
    _, got = _entities(spark, rows)
    assert got["one@x.com"] == got["two@x.com"] == got["three@x.com"] != got["four@x.com"]
    _, without = _entities(spark, [r for r in rows if r[1] != "T. Kesler"])
    assert without["one@x.com"] != without["three@x.com"]


def test_pairs_of_a_large_organisation(spark, monkeypatch):
    monkeypatch.setattr(entities, "PART", 3)
    df, got = _entities(spark, [(f"{box}@fimotal-energy.com", "Fimotal Energy Ltd") for box in ("info", "sales", "billing", "support", "office", "orders", "service", "help")] * 2)
    assert len(set(got.values())) == 1
    pairs = [tuple(r) for r in entities.found_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) == 28 and all(a < b for a, b in pairs)


def test_nulls_empty_and_repeated_rows(spark):
    df, got = _entities(spark, [(None, "Ann Smith"), ("no-at-sign", "Ann Smith"), ("Ann@X.com", None), ("ann@x.com", ""), ("ann@x.com", "Ann Smith"), ("ann@x.com", "Ann Smith"), ("q@x.com", None)])
    assert set(got) == {"ann@x.com", "q@x.com"} and got["ann@x.com"] != got["q@x.com"]
    assert entities.found_pairs(df.limit(0)).count() == 0
