"""Readers, writers and incremental runs."""

import base64
import json

import pytest

from postlane.functions import texts as T
from postlane.sources import mailbox, sinks
from postlane.streaming import incremental


@pytest.mark.parametrize(
    "source, want",
    [("<p>a<b>b</b></p>\n c", "a b c"), ("<style>x</style>y<script>z</script>", "y"), ("a &amp; b&nbsp;c", "a & b c"), ("", ""), (None, None), ("plain < text", "plain < text"), ("<div><p>open", "open")],
)
def test_html(source, want):
    assert T.plain_text(source) == want


def test_mime_prefers_html():
    data = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    part = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": data("plain")}}, {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": data("<b>rich</b>")}}]}]}
    assert T.mime_body(part) == "<b>rich</b>" and T.mime_body(None) is None and T.mime_body({"mimeType": "text/plain", "body": {"data": data("é")}}) == "é"


def test_corpus_lines_and_quarantine(spark, tmp_path):
    mail = {"id": "a", "sender_email": "x@y.example", "subject": "s", "references": ["r"]}
    (tmp_path / "c.json").write_text(json.dumps({"extraction_metadata": {"source": "m365", "total_emails": 2}, "emails": [mail, {"id": "", "sender_email": "z@y.example"}, {"id": "b", "sender_email": "nobody"}]}, indent=1))
    mails, meta = mailbox.read_corpus(spark, str(tmp_path / "c.json"))
    valid, bad = mailbox.check_rows(mails)
    assert [(r.id, r.sender_domain, r.place) for r in valid.collect()] == [("a", "y.example", 0)]
    assert sorted(r.error for r in bad.collect()) == ["no id", "no sender"] and meta.first().total_emails == 2
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{"id": \n\n{"id": "x"}\n{"id": 2, "more": 3}\n')
    rows, broken = mailbox.read_lines(spark, str(tmp_path / "l.jsonl"), "id bigint")
    assert sorted(r.id for r in rows.collect()) == [1, 2] and broken.count() == 2


def test_provider_messages(spark):
    data = base64.urlsafe_b64encode(b"<p>hello</p>").decode()
    g = {"id": "g", "threadId": "t", "internalDate": "1700000000000", "payload": {"mimeType": "text/html", "body": {"data": data}, "headers": [{"name": "FROM", "value": '"Ann B" <Ann@X.example>'}, {"name": "To", "value": "bob@y.example, c@z.example"}, {"name": "References", "value": "<a>  <b>"}], "parts": []}}
    r = mailbox.from_gmail(spark.read.schema(mailbox.GMAIL).json(spark.sparkContext.parallelize([json.dumps(g)]))).first()
    assert (r.sender_email, r.sender_name, r.sender_domain, r.recipient_email, r.subject, r.body_text, r.references, r.has_attachments, r.internal_date) == ("ann@x.example", "Ann B", "x.example", "bob@y.example", "(No subject)", "hello", ["<a>", "<b>"], False, 1700000000000)
    m = {"id": "m", "subject": "s", "receivedDateTime": "2024-01-01T00:00:00Z", "from": {"emailAddress": {"address": "A@x.example"}}, "toRecipients": [{"emailAddress": {"address": "B@y.example", "name": "B"}}], "body": {"contentType": "html", "content": "<p>x</p>y"}}
    r = mailbox.from_graph(spark.read.schema(mailbox.GRAPH).json(spark.sparkContext.parallelize([json.dumps(m)]))).first()
    assert (r.sender_email, r.sender_name, r.recipient_name, r.body_text, r.has_attachments) == ("a@x.example", "a", "B", "x y", False)


CATEGORIES = "category_id string, category_name string, description string, confidence double, email_count bigint, percentage double, source string, parent_category_id string"


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("c1", "A & <B>", "d", 0.5, 3, 60.0, "sender", None), ("c2", None, None, None, None, None, None, "c1")], CATEGORIES)
    sinks.write_csv(c, str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines[0].startswith("﻿category_id,") and any(x.endswith("A & <B>") for x in lines if x.startswith("c2"))
    assert "A &amp; &lt;B&gt;" in sinks.html_report(c) and "| A & <B> | 3 | 60.0% | 50% |" in sinks.markdown_report(c)
    import xml.etree.ElementTree as E

    assert E.fromstring(sinks.outlook_rules(c))[0].find("condition").text == "A & <B>"
    assert len(E.fromstring(sinks.gmail_filters(c).encode())) == 3
    log = spark.createDataFrame([("m", "Uncategorized"), ("n", "X")], "email_id string, category_name string")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


MAIL = "id string, pos bigint, ingested_at timestamp"


def test_incremental_runs(spark, tmp_path):
    folder, store, seen = str(tmp_path / "in"), str(tmp_path / "store"), []

    def arrive(rows):
        spark.createDataFrame(rows, MAIL).selectExpr("id", "pos", "ingested_at").coalesce(1).write.mode("append").parquet(folder)

    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    arrive([("a", 1, t), ("b", 2, t), ("a", 3, t)])
    schema = spark.createDataFrame([], MAIL).schema
    for more in ([("b", 4, t), ("c", 5, t)], None):
        incremental.run(incremental.mail_stream(spark, folder, schema), store, str(tmp_path / "check"), lambda df, n: seen.append(sorted(r.id for r in df.collect()))).awaitTermination()
        if more:
            arrive(more)
    assert seen == [["a", "b"], ["c"]]
    assert sorted((r.id, r.pos) for r in spark.read.parquet(store).collect()) == [("a", 1), ("b", 2), ("c", 5)]
    q = incremental.daily_counts(incremental.deduplicated(incremental.mail_stream(spark, folder, schema)), by=None)
    assert q.isStreaming and q.columns == ["start", "n"]
