"""Problem 1: the likeliest parent, the trees it makes, and whole conversations."""

import random

from pyspark.sql import functions as F

from postlane.llm import conversations
from tests.llm.brute_conversations import brute

MAIL = "id string, pos bigint, thread string, sender string, recipient string, subject string, utc_micros bigint, reply array<string>, refs array<string>, message_id string"
HOUR = 3_600_000_000
THREAD = [
    ("a", "ann", "bob", "oak tables", []),
    ("b", "cid", "dan", "oak tables", []),
    ("c", "bob", "ann", "Re: oak tables", []),  # answers ann, not the mail before
    ("d", "eve", None, "green lamps and shades", []),
    ("e", "fay", None, "oak tables", ["d"]),
    ("f", "gus", "hal", "Re: green lamps", []),  # shares words with an older mail only
    ("g", "fay", "ann", "chairs", ["gone"]),  # a name that no mail has; the latest from ann is the first
]


def _parents(spark, rows, **kw):
    mails = spark.createDataFrame([(i, n, "t", s, r, subject, n * HOUR, reply, [], None) for n, (i, s, r, subject, reply) in enumerate(rows)], MAIL)
    name = {n: row[0] for n, row in enumerate(rows)}
    links = conversations.reply_links(mails, conversations.named_mails(mails), **kw)
    return {name[r.pos]: name[r.parent] for r in links.collect()}


def test_parent_in_an_interleaved_thread(spark):
    assert _parents(spark, THREAD) == {"b": "a", "c": "a", "d": "c", "e": "d", "f": "d", "g": "a"}


def test_each_score_decides_a_parent(spark):
    assert _parents(spark, THREAD, weights=(0.6, 0.0, 0.6))["c"] == "b"  # without mentions the mail before wins
    assert _parents(spark, THREAD, weights=(0.6, 0.6, 0.0))["f"] == "e"  # without words as well
    # without time two mails of the same sender and subject are equal, and the later is taken by rule; with words alone the first with them
    assert _parents(spark, THREAD, weights=(0.0, 0.6, 0.6))["g"] == "a"


def test_links_are_a_forest_and_trees_are_completed(spark):
    rows = [("a", "ann", None, "x", []), ("b", "bob", None, "y", []), ("c", "cid", None, "z", ["a", "b"])]
    mails = spark.createDataFrame([(i, n, f"t{n}", s, r, subject, n * HOUR, reply[:1], reply[1:], None) for n, (i, s, r, subject, reply) in enumerate(rows)], MAIL)
    named = conversations.named_mails(mails)
    links = conversations.reply_links(mails, named)
    got = {r.pos: (r.tree, r.comp) for r in conversations.link_trees(mails, links, named).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0)}  # c hangs on a; the name of b joins the two trees


EMAIL = (
    "pos bigint, id string, mailbox string, sender_email string, recipient_email string, subject string, body_text string, received_date string, thread_id string, "
    "in_reply_to string, references_json string, provider_message_id string"
)
META = "user_email string, extraction_params map<string,string>"


def _random_mails(seed, n=160):
    rng = random.Random(seed)
    rows, clean = [], []
    for k in range(n):
        i = f"m{k}"
        named = [f"m{rng.randrange(n)}" if rng.random() < 0.1 else f"m{rng.randrange(max(0, k - 4), k)}" for _ in range(rng.choice([0, 0, 1, 2]))] if k else []
        if named and rng.random() < 0.1:
            named[0] = "gone"
        named = ["<p" + x[1:] + ">" if rng.random() < 0.3 and x != "gone" else x for x in named]
        reply = named[0] if named and rng.random() < 0.7 else rng.choice([None, "", "null"])
        thread = rng.choice([f"t{k // 6}", None, "none", "0000"])
        body = "text" if rng.random() < 0.95 else rng.choice(["", " \n ", None])
        at = f"2024-01-01T{k // 60:02d}:{k % 60:02d}:00Z" if rng.random() < 0.97 else "soon"
        row = (2 * k, i, "box", f"s{rng.randrange(3)}@x", f"s{rng.randrange(3)}@x", "subject", body, at, thread, reply, str(named).replace("'", '"'), f"<p{k}>")
        rows.append(row)
        if rng.random() < 0.1:
            rows.append((2 * k + 1, *row[1:]))
        clean.append({"id": i, "pos": 2 * k, "thread_id": thread, "in_reply_to": reply, "references_json": row[10], "provider_message_id": row[11], "sender_email": row[3], "body_text": body, "utc": None if at == "soon" else k})
    return rows, clean


def test_conversations_against_brute_force(spark):
    meta = spark.createDataFrame([("box", {"time_zone": "UTC", "date_order": "DMY"})], META)
    for seed in (1,):
        rows, clean = _random_mails(seed)
        got = conversations.conversations(spark.createDataFrame(rows, EMAIL).withColumn("comp", F.lit("clash")), meta).collect()
        assert sorted((r.conv_id, r.turn, r.email_id) for r in got) == sorted(brute(clean))
        openers = {r.conv_id: r.email_id for r in got if r.turn == 1}
        assert all(openers[r.conv_id] == r.conv_id for r in got) and {r.role for r in got} <= {"user", "assistant"}


def test_empty_table(spark):
    assert conversations.conversations(spark.createDataFrame([], EMAIL), spark.createDataFrame([], META)).count() == 0


def test_scoring_is_in_the_plan_that_makes_the_rows(spark, tmp_path):
    rows, _ = _random_mails(3, 30)
    mails = conversations.messages(spark.createDataFrame(rows, EMAIL), spark.createDataFrame([("box", {"time_zone": "UTC", "date_order": "DMY"})], META))
    named = conversations.named_mails(mails)
    links = conversations.reply_links(mails, named).select("pos", "parent")
    assert "array_intersect" in links._jdf.queryExecution().optimizedPlan().toString()
