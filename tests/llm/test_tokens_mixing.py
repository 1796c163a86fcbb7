"""Problems 7 and 8: ids against another encoder and back, shares and caps."""

import base64
import os
import random

import pytest

from postlane.llm import mixing, tokens

RANKS = tokens.DEFAULT_RANKS
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
TEXTS = ["", " ", "Hello  world", "naïve café — «ok» 123456", "tabs\tand\r\n\n lines ", "I'll we've don't 'S", "<|endoftext|> x", "日本語 テスト 😀👩‍👧", "éé    x", "x" * 3000, "a\u0000b", "  leading", "trailing   ", "12.5% of $3,000_000"]


def test_ids_are_those_of_another_encoder(spark):
    import sys

    import tiktoken

    sys.path.insert(0, os.path.dirname(os.path.realpath(os.path.dirname(RANKS))))
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "ab Z9'é\n\t.,-!日́ 😀s"
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300))]
    df = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "again"), (9001, "again")], "doc_id bigint, text string")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode(df).collect()]
    assert dict(got)[9000] == [] and sum(k == 9001 for k, _ in got) == 2
    names = [None] * len(ranks)
    for b, i in ranks.items():
        names[i] = b
    for k, ids in got:
        if k < 9000:
            assert ids == other.encode_ordinary(texts[k])
            assert tokens.decode(ids, names) == texts[k]
    assert tokens.encode(df.limit(0)).count() == 0


def _documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("one two three four five".split()) for _ in range(rng.randint(1, 30))) + f" {k}", rng.choice(["A", "a ", "a", "b", "c"])) for k in range(600)]
    rows += [(700, None, "a"), (701, "", "b"), (702, "text", None), (703, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_shares_are_reached_and_caps_are_kept(spark):
    targets = spark.createDataFrame([("a", 0.5, None), ("b", 0.3, None), ("c", 0.2, None), ("d", 0.3, 4), ("e", 0.0, None)], "source string, target_share double, max_repeats int")
    free = {r.source: r for r in mixing.shares(_documents(spark), targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(free[s].actual_share - share) < 0.03
    assert free["d"].n_uses == free["e"].n_uses == 0
    capped = targets.where("source != 'c'").unionByName(spark.createDataFrame([("c", 0.9, 2)], targets.schema))
    got = {r.source: r for r in mixing.shares(_documents(spark), capped).collect()}
    assert got["c"].most_uses <= 2 and got["c"].n_uses == 2 * got["c"].n_texts
    uses = mixing.mix(_documents(spark), capped).groupBy("source", "doc_id").count().collect()
    assert all(max(r["count"] for r in uses if r.source == s) - min(r["count"] for r in uses if r.source == s) <= 1 for s in ("a", "b", "c"))


def test_empty_tables(spark):
    docs, targets = _documents(spark), spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_plan_gives_what_caps_leave_to_the_others():
    got = mixing.plan_copies({"a": 10, "b": 10, "c": 80}, {"a": (0.5, 2), "b": (0.5, None), "c": (0.0, None)})
    assert got == {"a": 2.0, "b": 8.0}
