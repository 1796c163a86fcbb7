"""Operators against brute force on small and awkward data."""

import datetime as dt
import random
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlane.operators import graph, instants, keyed, learning, ranking, skew, suggest, threads, vectors


def test_quantiles_of_a_key_with_most_rows(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(-5000, 10**12)) for _ in range(900)] + [(None, 7), ("one", 3), ("none", None), ("two", 1), ("two", 2), ("hot", 5), ("hot", 5)]
    got = skew.key_quantiles(spark.createDataFrame(rows, "k string, v bigint"), F.col("k"), F.col("v"), (0.1, 0.5, 1.0), bins=16).collect()
    for r in got:
        own = sorted(v for k, v in rows if k == r.key and v is not None)
        want = own[max(1, int(np.ceil(r.fraction * len(own)))) - 1] if own else None
        assert (r.n, r.n_values, r.quantile) == (sum(k == r.key for k, _ in rows), len(own), want)
        assert r.ties == (own.count(want) if own else None)
    assert skew.key_quantiles(spark.createDataFrame([], "k string, v bigint"), F.col("k"), F.col("v")).count() == 0


def test_quantiles_beyond_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rows = [(f"k{n % 5}", n) for n in range(300)]
    got = skew.key_quantiles(spark.createDataFrame(rows, "k string, v bigint"), F.col("k"), F.col("v"), (0.5,), bins=8).collect()
    assert {r.key: r.quantile for r in got} == {f"k{n}": n + 5 * 29 for n in range(5)}


def test_hot_domains_come_from_the_selection(spark, monkeypatch):
    rows = [("Hot.example.", )] * 60 + [(" HOT.example",)] * 5 + [("warm.example",)] * 40 + [(f"cold{n}.example",) for n in range(880)] + [(None,)] * 15
    emails = spark.createDataFrame(rows, "sender_domain string")
    assert {r.sender_domain for r in skew.found_hot_domains(emails).collect()} == {"hot.example", "warm.example"}
    assert skew.found_hot_domains(emails.limit(0)).count() == 0
    monkeypatch.setattr(skew, "key_quantiles", lambda *a, **k: spark.createDataFrame([], "n bigint, quantile bigint, ties bigint"))
    assert skew.found_hot_domains(emails).count() == 0  # without the selection there is no row


def test_instants_of_every_year_against_zoneinfo(spark):
    rng, rows, want = random.Random(2), [], {}
    zones = ("America/New_York", "Europe/Berlin", "Africa/Casablanca", "Australia/Lord_Howe")
    for k in range(300):
        y, z = rng.choice([1700, 1850, 1920, 1950, 1969, 2020, 2037, 2045, 2060, 2089, 2100, 2130, 2400, 9000]), rng.choice(zones)
        t = dt.datetime(y, rng.randint(1, 12), rng.randint(1, 28), rng.randint(4, 23), 30, tzinfo=zoneinfo.ZoneInfo(z))
        rows.append((k, z, t.strftime("%Y-%m-%d %H:%M:%S").zfill(19)))
        want[k] = int((t.astimezone(dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 10**6
    mails = spark.createDataFrame(rows, "pos bigint, mailbox string, received_date string").withColumn("zone_status", F.lit("clash"))
    boxes = spark.createDataFrame([(z, z, "DMY") for z in zones], "mailbox string, time_zone string, date_order string")
    assert {r.pos: r.utc_micros for r in instants.normalise_instants(mails, boxes).collect()} == want


@pytest.mark.parametrize(
    "text, order, status, micros",
    [
        ("2024-03-31 02:30", "DMY", "nonexistent", 1711848600000000), ("2024-10-27 02:30", "DMY", "ambiguous", 1729989000000000), ("31.03.2024 04:30", "DMY", "unique", 1711852200000000), ("03/04/2024", "MDY", "unique", 1709506800000000),
        ("2024-03-31T02:30:00+02:00", "DMY", "offset", 1711845000000000), ("1711845000", "DMY", "epoch", 1711845000000000), ("soon", "DMY", None, None), ("", "DMY", None, None), (None, "DMY", None, None), ("31.02.2024 10:00", "DMY", None, None),
    ],
)
def test_notations(spark, text, order, status, micros):
    mails = spark.createDataFrame([(1, "Box ", text)], "pos bigint, mailbox string, received_date string")
    boxes = spark.createDataFrame([("box", "Europe/Berlin", order)], "mailbox string, time_zone string, date_order string")
    r = instants.normalise_instants(mails, boxes).first()
    assert (r.zone_status, r.utc_micros) == (status, micros)


def test_running_numbers_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{n % 5}", rng.randrange(10**6), n) for n in range(500)] + [(None, 1, 9001), (None, 2, 9000)]
    got = ranking.running(spark.createDataFrame(rows, "k string, t bigint, id bigint"), "k", [F.col("t"), F.col("id")], partitions=7).collect()
    place: dict = {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        place[i] = sum(1 for k2, t2, i2 in rows if k2 == k and (t2, i2) <= (t, i))
    assert {r.id: r.turn for r in got if r.k is not None} == {i: n for i, n in place.items() if i < 9000}


def test_components_and_forest(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 1), (5, 5)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {n: n for e in edges for n in e if n is not None and e[0] != e[1] and None not in e}
    for _ in range(80):
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    up = {n: n // 2 if n % 7 else n - 1 for n in range(1, 300)}
    want = {}
    for n in up:
        r = n
        while r in up:
            r = up[r]
        want[n] = r
    assert {r.node: r.root for r in graph.forest_roots(spark.createDataFrame(list(up.items()), "node bigint, up bigint")).collect()} == want
    assert graph.forest_roots(spark.createDataFrame([], "node bigint, up bigint")).count() == 0
    with pytest.raises(RuntimeError):
        graph.forest_roots(spark.createDataFrame([(1, 2), (2, 1)], "node bigint, up bigint"), max_rounds=4)


def test_windows_start_with_their_first_mail(spark):
    day = threads.DAY
    rows = [("a", "k", 0), ("b", "k", 6 * day), ("c", "k", 8 * day), ("d", "k", 14 * day), ("e", "k", 16 * day), ("f", "l", 0)]
    got = {r.id: r.thread for r in threads.anchored_windows(spark.createDataFrame(rows, "id string, key string, micros bigint")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f"}


def test_keyed_tables(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, pos bigint, v string")
    new = spark.createDataFrame([("b", 3, "z"), ("b", 4, "w"), ("c", 5, None)], "id string, pos bigint, v string")
    assert {(r.id, r.pos) for r in keyed.merge_by_key(old, new).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {(r.id, r.pos) for r in keyed.only_new(old, new).collect()} == {("c", 5)}
    import hashlib

    assert keyed.id_set_hash(new) == hashlib.sha256(b"b|c").hexdigest() and keyed.id_set_hash(new.limit(0)) == ""


def test_nearest_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6)).round(1)
    x[3] = 0
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [])]
    got = vectors.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=10, k=3, block=4).collect()
    for q in range(0, 120, 10):
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - (x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        want = [i for i in np.lexsort((np.arange(120), d)) if i != q and np.isfinite(d[i])][:3]
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want


def test_choice_of_k_and_nested_clusters(spark):
    assert vectors.elbow([(2, 9.0)]) == (2, 0.5)
    assert vectors.elbow([(2, 100.0), (3, 20.0), (4, 18.0), (5, 17.0)])[0] == 3
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, size=(20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, v.tolist(), i // 20) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    report = {r.k: r for r in vectors.cluster_report(df, [2, 3, 4]).collect()}
    assert report[3].is_best and not report[2].is_best
    tree = vectors.hierarchy(df, top=3, sub=2).collect()
    assert all(len({r.top_cluster for r in tree if r.sub_cluster == s}) == 1 for s in {r.sub_cluster for r in tree}) and len({r.top_cluster for r in tree}) == 3
    s = vectors.exact_silhouettes(df, block=16).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a = d[0, 1:20].mean()
    b = min(d[0, 20:40].mean(), d[0, 40:].mean())
    assert abs(next(r.silhouette for r in s if r.vec_id == 0) - (b - a) / max(a, b)) < 1e-9


def test_ensemble_and_decisions(spark):
    rows = [("m1", "a", "X", 0.9), ("m1", "b", "Y", 0.99), ("m2", "a", "X", 0.1), ("m2", "b", "Y", 0.3), ("m3", "a", "X", 0.3), ("m3", "b", "Y", 0.3), ("m4", "zzz", "Q", 1.0), ("m5", "a", "X", None)]
    got = {r.email_id: (r.category, r.source) for r in learning.ensemble(spark.createDataFrame(rows, "email_id string, source string, category_name string, confidence double"), [("a", 0.8), ("b", 0.5)]).collect()}
    assert got == {"m1": ("X", "ensemble:a"), "m2": ("Y", "ensemble:b"), "m3": ("X", "ensemble:a")}
    now = dt.datetime(2024, 1, 1)
    d = [("rename", "a", "b", 0.9, now)] * 4 + [("rename", "a", "a", 0.9, now)] * 9 + [("delete", "q", None, 0.3, now)] * 3 + [("delete", "r", None, 0.5, now)] * 9 + [("accept", "s", None, 0.9, now - dt.timedelta(days=90))] * 5
    df = spark.createDataFrame(d, "action string, old string, new string, confidence double, decided_at timestamp")
    found = learning.decision_patterns(df, F.lit(now)).collect()
    assert {(r.kind, r.old, r.new, r.threshold) for r in found} == {("rename", "a", "b", None), ("delete_low_confidence", None, None, 0.35)}
    s = spark.createDataFrame([("a", 0.9), ("z", 0.2), ("y", 0.9)], "name string, confidence double")
    assert {(r.name, r.action, r.new) for r in learning.learned_actions(s, learning.decision_patterns(df, F.lit(now)), 0.5).collect()} == {("a", "rename", "b"), ("z", "delete", None)}


def test_providers_that_fail(spark):
    mails = spark.createDataFrame([("a", "Meeting", None), ("b", None, "nothing")], "id string, subject string, body_text string")

    def bad():
        def ask(texts):
            raise OSError("no answer")

        return ask

    assert {(r.email_id, r.category_name, r.note) for r in learning.classify(mails, bad, ["X"]).collect()} == {("a", "Uncategorized", "no answer"), ("b", "Uncategorized", "no answer")}
    assert learning.checked(learning.Answer("other", 0.9), ["X"]) == learning.Answer("other", 0.3, "unknown category")
    v = learning.embed(mails, "subject", learning.hashed_vectors(8)).collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-6


def test_similar_suggestions_are_merged():
    s = suggest.Suggestion
    got = suggest.merge_similar([s("Newsletters", 100, 0.4, ("a",)), s("Newsletter", 80, 0.7, ("b",)), s("Invoices", 5, 0.5), s("Invoice", 90, 0.2)])
    assert [(x.name, x.count, x.ids) for x in got] == [("Newsletter", 80, ("a", "b")), ("Invoices", 5, ()), ("Invoice", 90, ())]


def test_rules_from_categories(spark):
    rows = [(n, f"m{n}", "Bill", f"invoice {w}", "a.example") for n, w in enumerate(["paid", "paid", "due"])] + [(9, "m9", "Other", None, None)]
    mails = spark.createDataFrame(rows, "pos bigint, id string, category string, subject string, sender_domain string")
    built = suggest.build_rules(suggest.rule_conditions(mails, keywords=2), ["Bill", "Other"])
    assert [(c.field, c.value) for c in built[0].conditions] == [("subject", "invoice"), ("subject", "paid"), ("sender_domain", "a.example")]
    assert [(c.field, c.value) for c in built[1].conditions] == [("subject", "Other")]
