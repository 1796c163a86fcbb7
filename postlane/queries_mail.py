"""Queries of the mail operators, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlane.functions import words as W
from postlane.operators import keyed, reports, rules, stats, threads, vectors
from postlane.session import table

M = "WITH m AS (SELECT * FROM emails WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)"
#: As-of time of the decaying weights, and the day that parts the corpus in two for comparisons.
AS_OF, HALF = "2025-01-01 00:00:00", "2023-07-01 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def mails(spark, d):
    return keyed.first_per_key(table(spark, d, "emails"))


def classified(spark, d):
    return table(spark, d, "classifications")


KEY = lambda c: f"trim(regexp_replace(lower({c}), '[\\s_\\-]+', ' ', 'g'))"
LATEST = f"latest AS (SELECT * FROM classifications WHERE email_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY classified_at DESC, id DESC) = 1)"  # noqa: F541


# ---- volume, senders, subjects, days
@query(f"""{M} SELECT count(*) AS total_emails, count(DISTINCT lower(sender_email)) AS unique_senders, count(*) FILTER (has_attachments) AS with_attachments,
    CAST(floor(avg(coalesce(length(body_text), 0))) AS BIGINT) AS avg_body_length, min(ingested_at) AS oldest, max(ingested_at) AS newest,
    count(*) FILTER (has_attachments) * 100.0 / count(*) AS attachment_pct,
    greatest(1, (epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) // 86400000000) AS span_days,
    count(*) / greatest(1, (epoch_us(max(ingested_at)) - epoch_us(min(ingested_at))) // 86400000000) AS emails_per_day FROM m""")
def a1_volume_stats(spark, d):
    return stats.volume(mails(spark, d))


_SENDERS = f"""{M}, b AS (SELECT lower(sender_email) AS email, sender_name, subject, pos FROM m WHERE sender_email IS NOT NULL),
    g AS (SELECT email, count(*) AS n, min(pos) AS first_pos, arg_min(sender_name, pos) FILTER (trim(sender_name) <> '') AS name FROM b GROUP BY email),
    s AS (SELECT email, list(subject ORDER BY pos) AS sample_subjects FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY email ORDER BY pos) <= 5) GROUP BY email),
    j AS (SELECT g.*, s.sample_subjects, CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) ELSE 'unknown' END AS domain,
      lower(array_to_string(list_transform(s.sample_subjects, lambda x: coalesce(x, '')), ' ')) AS t FROM g JOIN s USING (email)),
    k AS (SELECT email, n, first_pos, name, sample_subjects, domain, CASE WHEN regexp_matches(email, 'noreply|no-reply|donotreply|notification|notify|alert') THEN 'service'
      WHEN n > 10 AND regexp_matches(t, 'unsubscribe|promotional|offer|discount|sale|promotion') THEN 'marketing'
      WHEN regexp_matches(t, 'meeting|project|team|re:|fwd:') THEN 'work' ELSE 'personal' END AS type FROM j)"""


@query(f"{_SENDERS} SELECT * FROM k ORDER BY n DESC, first_pos LIMIT 50")
def a2_top_senders(spark, d):
    return stats.top_senders(mails(spark, d))


@query(f"{_SENDERS} SELECT type, count(*) AS senders, CAST(sum(n) AS BIGINT) AS mails FROM k GROUP BY type")
def a4_sender_types(spark, d):
    return stats.senders(mails(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("senders"), F.sum("n").alias("mails"))


@query(f"{M} SELECT sender_domain, count(*) AS n, min(pos) AS first_pos FROM m GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 30")
def a3_top_domains(spark, d):
    return stats.top_values(mails(spark, d), "sender_domain", 30)


@query(f"{M} SELECT upper(regexp_extract(subject, '(?i)^(re|fwd):', 1)) || ':' AS prefix, count(*) AS n FROM m WHERE regexp_matches(subject, '(?i)^(re|fwd):') GROUP BY 1")
def a5_subject_prefixes(spark, d):
    return stats.subject_prefixes(mails(spark, d))


@query(f"""{M}, w AS (SELECT unnest(regexp_extract_all(subject, '([\\p{{L}}\\p{{N}}_]+)\\s*[#№]\\s*\\d+', 1)) AS w FROM m)
    SELECT upper(w[1]) || lower(w[2:]) AS pattern, count(*) AS n FROM w GROUP BY 1""")
def a6_numbered_subjects(spark, d):
    return stats.numbered_subjects(mails(spark, d))


_STOP = ", ".join(f"'{w}'" for w in W.STOP_WORDS)


@query(f"""{M}, t AS (SELECT pos, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(subject, '^re:\\s*', '', 'i'), '^fwd:\\s*', '', 'i'),
    '[\\[\\(][^\\]\\)]+[\\]\\)]', '', 'g'), '[\\p{{L}}\\p{{N}}_]+\\s*[#№]\\s*\\d+', '', 'g')), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM m)
    SELECT keyword, count(*) AS n, min(pos) AS first_pos FROM t WHERE regexp_full_match(keyword, '[a-z]{{2,}}') AND keyword NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, first_pos, keyword LIMIT 50""")
def a7_keywords(spark, d):
    return stats.keywords(mails(spark, d))


@query(f"""{M}, t AS (SELECT pos, trim(unnest(regexp_extract_all(subject, '[\\[\\(]([^\\]\\)]+)[\\]\\)]', 1))) AS tag FROM m) SELECT tag, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY 1""")
def a8_bracket_tags(spark, d):
    return stats.subject_tokens(mails(spark, d), W.bracket_tags, "tag")


_FREQ = f"""{M}, a AS (SELECT sender_email, count(*) AS n, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM m GROUP BY 1),
    g AS (SELECT *, CASE WHEN n > 1 THEN (epoch_us(last_at) - epoch_us(first_at)) / 86400000000 / (n - 1) END AS gap FROM a),
    f AS (SELECT *, CASE WHEN n = 1 THEN 'one-time' WHEN n < 10 THEN 'occasional' WHEN gap < 2 THEN 'daily' WHEN gap < 8 THEN 'weekly' WHEN gap < 35 THEN 'monthly' ELSE 'occasional' END AS frequency FROM g)"""


@query(f"{_FREQ} SELECT * FROM f")
def a9_frequency(spark, d):
    return stats.frequency(mails(spark, d))


@query(f"{_FREQ} SELECT e.frequency, count(f.frequency) AS n FROM (VALUES ('daily'), ('weekly'), ('monthly'), ('occasional'), ('one-time')) e(frequency) LEFT JOIN f USING (frequency) GROUP BY 1")
def a9_frequency_distribution(spark, d):
    return stats.frequency_distribution(mails(spark, d))


@query(f"{M} SELECT count(*) AS n, count(DISTINCT sender_email) AS senders, count(DISTINCT sender_domain) AS domains, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM m")
def a28_corpus_info(spark, d):
    return stats.corpus_info(mails(spark, d))


_DAYS = f"""{M}, c AS (SELECT CAST(ingested_at AS DATE) AS day, count(*) AS n FROM m GROUP BY 1), e AS (SELECT max(day) AS b, min(day) AS a FROM c),
    s AS (SELECT CAST(unnest(generate_series(greatest(a, b - 29), b, INTERVAL 1 DAY)) AS DATE) AS day FROM e), f AS (SELECT s.day, coalesce(c.n, 0) AS n FROM s LEFT JOIN c USING (day))"""


@query(f"{_DAYS} SELECT * FROM f")
def a24_daily_counts(spark, d):
    return stats.daily_counts(mails(spark, d))


@query(f"""{_DAYS}, g AS (SELECT avg(n) AS mean, stddev_pop(n) AS std, count(*) AS k FROM f)
    SELECT day, n, mean, (n - mean) / std AS z FROM f, g WHERE k >= 2 AND std > 0 AND abs((n - mean) / std) >= 2""")
def a24_volume_anomalies(spark, d):
    return stats.volume_anomalies(mails(spark, d))


# ---- clusters over the vectors
_CENT = "c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), cc AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY 1)"
_DIST = f"WITH {_CENT}, dd AS (SELECT vec_id, e.label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS distance FROM embeddings e JOIN cc USING (label))"


@query(f"{_DIST} SELECT label, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM embeddings) AS pct, avg(distance) AS cohesion FROM dd GROUP BY 1")
def a10_cluster_summary(spark, d):
    return vectors.cohesion(table(spark, d, "embeddings"))


@query(f"{_DIST} SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM dd QUALIFY rank <= 5")
def w1_representatives(spark, d):
    return vectors.representatives(table(spark, d, "embeddings"))


@query("SELECT vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def o7_nearest_to_one(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.nearest_to(v, v.orderBy("vec_id").select("embedding").first()[0])


@query("""SELECT q.vec_id AS query, e.vec_id AS neighbour, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def j20_nearest_neighbours(spark, d):
    return vectors.nearest_neighbours(table(spark, d, "embeddings"))


@query(f"""WITH {_CENT} SELECT vec_id, arg_max(label, (s, -label)) AS assigned, max(s) AS similarity FROM
    (SELECT vec_id, cc.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, cc) GROUP BY 1""")
def j21_assign_nearest(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.assign_nearest(v, vectors.centroids(v))


@query("""WITH p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS m, count(*) AS k
    FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, label, max(CASE WHEN other = label AND k > 1 THEN m * k / (k - 1) END) AS a, min(CASE WHEN other <> label THEN m END) AS b FROM p GROUP BY 1, 2)
    SELECT label, count(*) AS n, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s GROUP BY 1""")
def m5_silhouettes(spark, d):
    return vectors.silhouettes(table(spark, d, "embeddings"))


@query()
def m1_kmeans(spark, d):
    return vectors.kmeans(table(spark, d, "embeddings"))


@query()
def m2_kmeans_on_components(spark, d):
    return vectors.kmeans(table(spark, d, "embeddings"), pca=8)


@query()
def m3_inertia_curve(spark, d):
    return vectors.inertia_curve(table(spark, d, "embeddings"), [2, 4, 6, 8, 10, 12])


@query()
def m6_hierarchy(spark, d):
    return vectors.hierarchy(table(spark, d, "embeddings"))


# ---- rules
C = rules.Condition
RULES = [
    rules.Rule("r1", "Billing and Invoices", (C("subject", "contains", "invoice"), C("subject", "contains", "rechnung"), C("subject", "contains", "faktura")), "or", 80, True, "cat_02"),
    rules.Rule("r2", "System Alerts", (C("sender_domain", "equals", "pingboard.example"),), "and", 90, True, "cat_07"),
    rules.Rule("r3", "Team Meetings", (C("subject", "starts_with", "minutes"), C("recipient_email", "not_contains", "helpdesk")), "and", 70, True, "cat_05"),
    rules.Rule("r4", "Newsletters", (C("sender_email", "in_list", "news@shopwell-mail.example, statements@ledgerly.example"), C("sender_name", "ends_with", "team")), "or", 60, True, "cat_01"),
    rules.Rule("r5", "Order Updates", (C("subject", "matches_regex", r"(delivery|lieferung|livraison) .*\d+"),), "and", 85, True, "cat_00"),
    rules.Rule("r6", "Deliveries", (C("has_attachments", "equals", "true"), C("subject", "matches_regex", "(unclosed")), "and", 50, True, "cat_16"),
    rules.Rule("r7", "Deliveries", (C("subject", "contains", "Delivery", True), C("recipient_email", "not_equals", "nobody@example.org")), "and", 85, True, "cat_16"),
    rules.Rule("r8", "Personal", (C("sender_domain", "equals", "postkorb.example"),), "and", 10, False, "cat_15"),
]
_R = f"""{M}, r AS (SELECT id, pos,
    coalesce(contains(lower(subject), 'invoice'), false) OR coalesce(contains(lower(subject), 'rechnung'), false) OR coalesce(contains(lower(subject), 'faktura'), false) AS r1,
    coalesce(lower(sender_domain) = 'pingboard.example', false) AS r2,
    coalesce(starts_with(lower(subject), 'minutes'), false) AND coalesce(NOT contains(lower(recipient_email), 'helpdesk'), true) AS r3,
    coalesce(lower(sender_email) IN ('news@shopwell-mail.example', 'statements@ledgerly.example'), false) OR coalesce(ends_with(lower(sender_name), 'team'), false) AS r4,
    coalesce(regexp_matches(subject, '(?i)(delivery|lieferung|livraison) .*\\d+'), false) AS r5,
    coalesce(contains(subject, 'Delivery'), false) AND coalesce(lower(recipient_email) <> 'nobody@example.org', true) AS r7 FROM m),
    h AS (SELECT id, pos, v.* FROM r, LATERAL (SELECT * FROM (VALUES (r2, 'r2', 'System Alerts', 90, 1, 1, 'cat_07'), (r5, 'r5', 'Order Updates', 85, 1, 2, 'cat_00'), (r7, 'r7', 'Deliveries', 85, 2, 3, 'cat_16'),
      (r1, 'r1', 'Billing and Invoices', 80, 3, 4, 'cat_02'), (r3, 'r3', 'Team Meetings', 70, 2, 5, 'cat_05'), (r4, 'r4', 'Newsletters', 60, 2, 6, 'cat_01')) t(hit, rule_id, category, priority, conditions, o, cid)) v WHERE v.hit)"""


@query(f"{_R} SELECT id, list(rule_id ORDER BY o) AS matched_rules FROM h GROUP BY id")
def pr9_evaluate_rules(spark, d):
    e = rules.evaluate(mails(spark, d), RULES).where(F.size("matched") > 0)
    return e.select("id", F.transform("matched", lambda m: m["rule_id"]).alias("matched_rules"))


@query(f"""{_R}, g AS (SELECT id, list(rule_id ORDER BY o) AS matched_rules, arg_min(category, o) AS category, arg_min(rule_id, o) AS rid, arg_min(priority, o) AS p,
    list(category ORDER BY o) AS cs FROM h GROUP BY id)
    SELECT m.id, coalesce(g.category, 'Uncategorized') AS category, CASE WHEN g.id IS NULL THEN 0.0 ELSE 0.1 + least(p / 100.0, 1.0) * 0.9 END AS confidence,
    CASE WHEN g.id IS NULL THEN 'none' ELSE 'rule:' || rid END AS source, coalesce(list_filter(cs, lambda c, i: c <> g.category AND list_position(cs, c) = i), []) AS secondary, coalesce(g.matched_rules, []) AS matched_rules FROM m LEFT JOIN g USING (id)""")
def m19_categorise(spark, d):
    return rules.categorise(mails(spark, d), RULES)


@query(f"""{_R}, g AS (SELECT id, arg_min(rule_id, (-conditions, -priority, o)) AS rule_id, arg_min(category, (-conditions, -priority, o)) AS category, arg_min(conditions, (-conditions, -priority, o)) AS k,
    list(category ORDER BY conditions DESC, priority DESC, o) AS cs FROM h GROUP BY id)
    SELECT id, rule_id, category, least(0.5 + 0.25 * ln(k + 1.0), 1.0) AS confidence, list_filter(cs, lambda c, i: c <> category AND list_position(cs, c) = i) AS alternatives FROM g""")
def m18_resolve_conflicts(spark, d):
    return rules.resolve(mails(spark, d), RULES, ("specificity", "priority"))


@query(f"""{_R}, x AS (SELECT rule_id, count(*) AS n, list(id ORDER BY pos) AS ids FROM h GROUP BY 1)
    SELECT v.rule_id, coalesce(n, 0) AS n, coalesce(n * 100.0 / (SELECT count(*) FROM m), 0) AS pct, coalesce(ids[1:5], []) AS examples
    FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6'), ('r7'), ('r8')) v(rule_id) LEFT JOIN x USING (rule_id)""")
def a11_rule_report(spark, d):
    return rules.rule_report(mails(spark, d), RULES)


@query(f"""{_R}, g AS (SELECT id, count(*) AS k, count(DISTINCT cid) AS c FROM h GROUP BY id)
    SELECT (SELECT count(*) FROM m) AS total, count(*) AS covered, (SELECT count(*) FROM m) - count(*) AS uncovered, count(*) FILTER (k > 1 AND c > 1) AS conflicts FROM g""")
def a11_rule_coverage(spark, d):
    return rules.rule_coverage(mails(spark, d), RULES)


@query(f"""{_R}, p AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n FROM h a JOIN h b ON a.id = b.id AND a.rule_id <> b.rule_id GROUP BY 1, 2),
    v AS (SELECT * FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6'), ('r7')) v(r))
    SELECT a.r AS rule_a, b.r AS rule_b, coalesce(n, 0) AS n FROM v a JOIN v b ON a.r <> b.r LEFT JOIN p ON p.rule_a = a.r AND p.rule_b = b.r""")
def j13_rule_confusion(spark, d):
    return rules.rule_confusion(mails(spark, d), RULES)


@query(f"{_R} SELECT category, count(*) AS n FROM (SELECT arg_min(category, o) AS category FROM h GROUP BY id) GROUP BY 1")
def a12_categories_used(spark, d):
    return rules.categorise(mails(spark, d), RULES).where("source != 'none'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---- classifications, corrections, coverage, drift
@query(f"WITH {LATEST} SELECT email_id, category_name, confidence, source, model_version, classified_at, id FROM latest")
def w3_latest_classification(spark, d):
    return reports.latest_per_mail(classified(spark, d))


@query(f"WITH {LATEST} SELECT {KEY('category_name')} AS category, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM latest) AS pct FROM latest GROUP BY 1")
def a13_per_category(spark, d):
    return reports.per_category(reports.latest_per_mail(classified(spark, d)))


@query(f"WITH {LATEST}, c AS (SELECT {KEY('category_name')} AS category, count(*) AS n FROM latest GROUP BY 1) SELECT avg(n) AS mean, median(n) AS median, stddev_pop(n) AS std, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max FROM c")
def a14_distribution(spark, d):
    return reports.distribution(reports.per_category(reports.latest_per_mail(classified(spark, d))))


_UNC = f"{M}, {LATEST}, u AS (SELECT * FROM m WHERE id NOT IN (SELECT email_id FROM latest WHERE {KEY('category_name')} <> 'uncategorized'))"
_PREFIX = r"CASE WHEN regexp_matches(trim(subject), '^\[[^\]]*\]') THEN regexp_extract(trim(subject), '^(\[[^\]]*\])', 1) WHEN regexp_matches(trim(subject), '^(RE:|Re:|FWD:|Fwd:|FW:|Fw:)') THEN regexp_extract(trim(subject), '^(RE:|Re:|FWD:|Fwd:|FW:|Fw:)', 1) END"
_PAT = f"""{_UNC}, x AS (SELECT 'domain' AS kind, lower(sender_domain) AS value, id, pos FROM u UNION ALL SELECT 'sender', lower(sender_email), id, pos FROM u UNION ALL SELECT 'subject_prefix', {_PREFIX}, id, pos FROM u),
    q AS (SELECT kind, value, count(*) AS n, list(id ORDER BY pos)[1:5] AS examples FROM x WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(f"{_PAT} SELECT * FROM q")
def a15_uncategorised_patterns(spark, d):
    return reports.patterns(reports.uncategorised(mails(spark, d), reports.latest_per_mail(classified(spark, d))))


@query(f"{_PAT}, t AS (SELECT count(*) AS total FROM u) SELECT kind, value, n, n / total AS share, CASE WHEN n / total >= 0.3 THEN 'high' WHEN n / total >= 0.1 THEN 'medium' ELSE 'low' END AS priority FROM q, t")
def a16_recommendations(spark, d):
    u = reports.uncategorised(mails(spark, d), reports.latest_per_mail(classified(spark, d)))
    return reports.recommendations(reports.patterns(u), u.agg(F.count(F.lit(1)).alias("total")))


_ACC = f"""WITH a AS (SELECT {KEY('category_name')} AS category, count(*) AS classified FROM classifications GROUP BY 1), b AS (SELECT {KEY('old_category')} AS category, count(*) AS corrected FROM corrections GROUP BY 1),
    r AS (SELECT category, coalesce(classified, 0) AS classified, coalesce(corrected, 0) AS corrected, CASE WHEN coalesce(classified, 0) = 0 THEN CASE WHEN corrected > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, coalesce(corrected, 0) / classified) END AS correction_rate
    FROM a FULL JOIN b USING (category))"""


@query(f"{_ACC} SELECT * FROM r")
def a17_accuracy(spark, d):
    return reports.accuracy(classified(spark, d), table(spark, d, "corrections"))


@query(f"{_ACC} SELECT coalesce(bool_or(correction_rate > 0.2) AND sum(classified) > 0, false) AS needs_retraining, (SELECT category FROM r ORDER BY correction_rate DESC, category LIMIT 1) AS worst FROM r")
def a18_needs_retraining(spark, d):
    return reports.needs_retraining(reports.accuracy(classified(spark, d), table(spark, d, "corrections")))


@query("SELECT count(*) AS total, count(DISTINCT email_id) AS mails, count(DISTINCT email_id) / count(*) AS distinct_rate FROM corrections")
def a19_correction_stats(spark, d):
    return reports.correction_stats(table(spark, d, "corrections"))


@query(f"SELECT {KEY('old_category')} AS old, {KEY('new_category')} AS new, count(*) AS n FROM corrections GROUP BY 1, 2")
def a19_correction_pairs(spark, d):
    return reports.correction_pairs(table(spark, d, "corrections"))


_AGE = f"greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(corrected_at)) / 86400000000)"


@query(f"SELECT id, email_id, weight * exp(-0.01 * {_AGE}) AS decayed_weight FROM corrections WHERE weight * exp(-0.01 * {_AGE}) >= 0.1")
def a20_decayed_corrections(spark, d):
    return reports.decayed(table(spark, d, "corrections"), F.lit(AS_OF).cast("timestamp")).select("id", "email_id", "decayed_weight")


@query(f"""WITH g AS (SELECT {KEY('old_category')} AS old, {KEY('new_category')} AS new, count(*) AS n, sum(pow(2.0, -{_AGE} / 90.0)) AS weight FROM corrections GROUP BY 1, 2)
    SELECT *, least(0.5 + 0.2 * CASE WHEN weight / 3 > 1 THEN log2(weight / 3) ELSE 0 END, 0.99) AS confidence FROM g WHERE weight >= 3 - 1e-6 AND old <> new""")
def a21_rename_patterns(spark, d):
    return reports.rename_patterns(table(spark, d, "corrections"), F.lit(AS_OF).cast("timestamp"))


@query(f"SELECT category, sum(s) AS score FROM (SELECT {KEY('new_category')} AS category, 1.0::DOUBLE AS s FROM corrections UNION ALL SELECT {KEY('old_category')}, -1.0::DOUBLE FROM corrections) GROUP BY 1")
def a22_historical_scores(spark, d):
    return reports.historical_scores(table(spark, d, "corrections"))


def _halves(spark, d):
    m = mails(spark, d)
    t = F.lit(HALF).cast("timestamp")
    latest = reports.latest_per_mail(classified(spark, d)).select(F.col("email_id").alias("id"), reports.category_key(F.col("category_name")).alias("cluster"))
    j = m.select("id", "ingested_at", F.lower("sender_domain").alias("domain")).join(latest, "id")
    return j.where(F.col("ingested_at") < t), j.where(F.col("ingested_at") >= t)


def _pct(x):
    return x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("t")))).select("cluster", (F.col("n") * 100.0 / F.col("t")).alias("pct"))


def _fraction(x):
    return x.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(x.where("domain is not null").agg(F.count(F.lit(1)).alias("t")))).select("domain", (F.col("n") / F.col("t")).alias("fraction"))


_HALVES = f"""{M}, {LATEST}, j AS (SELECT m.id, ingested_at < TIMESTAMP '{HALF}' AS early, lower(sender_domain) AS domain, {KEY('category_name')} AS cluster FROM m JOIN latest ON latest.email_id = m.id),
    p AS (SELECT early, cluster, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY early) AS pct FROM j GROUP BY 1, 2),
    f AS (SELECT early, domain, count(*) / sum(count(*)) OVER (PARTITION BY early) AS fraction FROM j WHERE domain IS NOT NULL GROUP BY 1, 2),
    jc AS (SELECT cluster, coalesce(a.pct, 0) AS old_pct, coalesce(b.pct, 0) AS new_pct FROM (SELECT * FROM p WHERE early) a FULL JOIN (SELECT * FROM p WHERE NOT early) b USING (cluster))"""


@query(f"{_HALVES} SELECT cluster, old_pct, new_pct, abs(new_pct - old_pct) / 100 AS change FROM jc")
def j6_cluster_changes(spark, d):
    a, b = _halves(spark, d)
    return reports.cluster_changes(_pct(a), _pct(b))


@query(f"""{_HALVES}, x AS (SELECT sum(abs(new_pct - old_pct)) AS c FROM jc), y AS (SELECT sum(abs(coalesce(a.fraction, 0) - coalesce(b.fraction, 0))) AS d FROM (SELECT * FROM f WHERE early) a FULL JOIN (SELECT * FROM f WHERE NOT early) b USING (domain))
    SELECT least(c / 200, 1.0) * 0.8 + d / 2 * 0.2 AS drift, c AS cluster_change, d AS domain_change FROM x, y""")
def a23_drift(spark, d):
    a, b = _halves(spark, d)
    return reports.drift(_pct(a), _pct(b), _fraction(a), _fraction(b))


@query(f"""{_HALVES}, g AS (SELECT cluster, count(*) AS n, count(*) FILTER (NOT early) AS n_new FROM j GROUP BY 1) SELECT * FROM g WHERE n_new >= 10 AND n_new / n > 0.5""")
def a25_emerging_topics(spark, d):
    a, b = _halves(spark, d)
    return reports.emerging(a.unionByName(b).select("cluster", "id"), a.select("cluster", "id"))


@query("SELECT action_type, count(*) AS n, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (reversible) AS reversible FROM action_log GROUP BY 1")
def a26_action_summary(spark, d):
    return reports.action_summary(table(spark, d, "action_log"))


@query("SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM classifications) AS hit_rate, avg(confidence) AS mean_confidence FROM classifications GROUP BY 1")
def a27_source_usage(spark, d):
    return reports.source_usage(classified(spark, d))


@query("""WITH u AS (SELECT target_id, max(action_time) AS undone_at FROM action_log WHERE action_type = 'rollback' AND target_id IS NOT NULL GROUP BY 1)
    SELECT id, action_time, action_type, target_id, CASE WHEN json_valid(details_json) THEN details_json ->> '$.to' END AS from_folder,
    CASE action_type WHEN 'move' THEN 'move' WHEN 'archive' THEN 'unarchive' WHEN 'mark_read' THEN 'mark_unread' ELSE 'undo_' || action_type END AS reverse_type
    FROM action_log LEFT JOIN u USING (target_id) WHERE reversible AND success AND action_type <> 'rollback' AND target_id IS NOT NULL AND (undone_at IS NULL OR undone_at < action_time)""")
def j18_rollback_candidates(spark, d):
    return reports.rollback_candidates(table(spark, d, "action_log"))


@query(f"WITH {LATEST} SELECT email_id, category_name, confidence FROM latest WHERE {KEY('category_name')} <> 'uncategorized' ORDER BY confidence, email_id LIMIT 10")
def o4_uncertain(spark, d):
    return reports.uncertain(reports.latest_per_mail(classified(spark, d)))


@query(f"""WITH l AS (SELECT email_id, source, {KEY('category_name')} AS c, confidence FROM classifications WHERE email_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY email_id, source ORDER BY classified_at DESC, id DESC) = 1)
    SELECT a.email_id, a.c AS a_category, a.confidence AS a_confidence, b.c AS b_category, b.confidence AS b_confidence, abs(a.confidence - b.confidence) AS gap FROM l a JOIN l b USING (email_id) WHERE a.source = 'rule' AND b.source = 'ensemble' AND a.c <> b.c""")
def j5_disagreements(spark, d):
    return reports.disagreements(classified(spark, d), "rule", "ensemble")


@query(f"""WITH s AS (SELECT DISTINCT {KEY('category_name')} AS category, email_id AS id FROM classifications WHERE email_id IS NOT NULL), n AS (SELECT category, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.category AS a, y.category AS b, count(*) AS b2 FROM s x JOIN s y ON x.id = y.id AND x.category < y.category GROUP BY 1, 2)
    SELECT a, b, b2 AS both, na.n + nb.n - b2 AS either, b2 / (na.n + nb.n - b2) AS jaccard FROM p JOIN n na ON na.category = a JOIN n nb ON nb.category = b""")
def j12_category_overlap(spark, d):
    c = classified(spark, d).where("email_id is not null")
    return reports.overlaps(c.select(reports.category_key(F.col("category_name")).alias("category"), F.col("email_id").alias("id")))


@query(f"""{M}, l AS (SELECT email_id, new_category AS category FROM corrections QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY corrected_at DESC, id DESC) = 1),
    r AS (SELECT l.email_id, concat_ws(' ', subject, body_text) AS text, category FROM l JOIN m ON m.id = l.email_id) SELECT * FROM r WHERE category IN (SELECT category FROM r GROUP BY 1 HAVING count(*) >= 8)""")
def j11_training_set(spark, d):
    return reports.training_set(mails(spark, d), table(spark, d, "corrections"))


# ---- categories
@query("SELECT c.*, p.category_name AS parent_name FROM categories c LEFT JOIN categories p ON c.parent_category_id = p.category_id")
def j17_category_parents(spark, d):
    return reports.with_parents(table(spark, d, "categories"))


@query("""WITH h AS (SELECT * FROM categories WHERE contains(lower(source), 'template')), k AS (SELECT category_id FROM h UNION SELECT parent_category_id FROM h WHERE parent_category_id IS NOT NULL) SELECT * FROM categories WHERE category_id IN (SELECT category_id FROM k)""")
def pr10_filter_categories(spark, d):
    return reports.filter_categories(table(spark, d, "categories"), "source:template")


@query("SELECT category_id, row_number() OVER (ORDER BY email_count DESC NULLS LAST, category_id) AS place FROM categories")
def o5_sorted_categories(spark, d):
    from postlane.operators.ranking import running

    c = table(spark, d, "categories").withColumn("all", F.lit("x"))
    return running(c, "all", [F.coalesce(-F.col("email_count"), F.lit(1)), F.col("category_id")], name="place").select("category_id", "place")


@query("""WITH b AS (SELECT category_id, category_name, least(1.0, log10(coalesce(email_count, 0) + 1.0) / log10(101.0)) AS v, CASE source WHEN 'template' THEN 0.9 WHEN 'content_cluster' THEN 0.8 WHEN 'sender' THEN 0.7 ELSE 0.5 END AS s,
    least(1.0, coalesce(percentage, 0.0) / 10) AS p FROM categories) SELECT category_id, (v + s + p) / 3 AS plain_confidence FROM b""")
def m12_category_confidence(spark, d):
    return reports.category_confidence(table(spark, d, "categories")).select("category_id", "plain_confidence")


@query()
def f23_name_quality(spark, d):
    return table(spark, d, "categories").select("category_id", W.name_quality(F.col("category_name")).alias("q")).select("category_id", "q.*")


# ---- threads
def threadable(spark, d):
    m = mails(spark, d)
    reply = F.get(threads.header_names(F.col("in_reply_to")), F.lit(0))
    return m.withColumn("reply", reply).withColumn("references", threads.header_names(F.col("references_json")))


_NAMES = """list_filter(regexp_extract_all({c}, '[^\\s"''<>\\[\\]{{}},;\\\\]+'), lambda t: lower(t) NOT IN ('', 'null', 'none', 'undefined', 'n/a', '0'))"""


@query(f"""{M}, g AS (SELECT id, {_NAMES.format(c='in_reply_to')} AS r, {_NAMES.format(c='references_json')} AS f FROM m),
    x AS (SELECT id, unnest(f) AS name, 0 AS rank, unnest(range(len(f))) AS place FROM g UNION ALL SELECT id, r[1], 1, 0 FROM g WHERE r[1] IS NOT NULL)
    SELECT x.id, arg_max(name, (rank, place)) AS parent FROM x JOIN m ON m.id = x.name WHERE name <> x.id GROUP BY 1""")
def j2_parent_links(spark, d):
    return threads.parent_links(threadable(spark, d))


@query()
def m17_threads(spark, d):
    return threads.threads(threadable(spark, d))


@query()
def a29_thread_rollup(spark, d):
    m = threadable(spark, d)
    return threads.thread_rollup(m, threads.threads(m))


# ---- keyed tables
@query(f"{M} SELECT id, pos FROM m")
def s14_first_per_key(spark, d):
    return mails(spark, d).select("id", "pos")


@query("SELECT id, CASE WHEN min(s) = 0 THEN min(pos) FILTER (s = 0) ELSE min(pos) END AS pos FROM (SELECT id, pos, CASE WHEN provider = 'm365' THEN 0 ELSE 1 END AS s FROM emails WHERE id IS NOT NULL) GROUP BY id")
def u1_union_sources(spark, d):
    e = table(spark, d, "emails")
    return keyed.union_first([e.where("provider = 'm365'"), e.where("provider != 'm365'")]).select("id", "pos")


@query(f"SELECT id, max(pos) AS pos FROM emails WHERE id IS NOT NULL GROUP BY id")  # noqa: F541
def k2_merge_by_key(spark, d):
    e = table(spark, d, "emails").where("id is not null")
    t = F.lit(HALF).cast("timestamp")
    first, last = e.where(F.col("ingested_at") < t), e.where(F.col("ingested_at") >= t)
    return keyed.merge_by_key(keyed.merge_by_key(first.limit(0), first), last).select("id", "pos")


@query("SELECT id, min(pos) AS pos FROM emails WHERE id IS NOT NULL AND NOT coalesce(has_attachments, false) AND id NOT IN (SELECT id FROM emails WHERE has_attachments AND id IS NOT NULL) GROUP BY id")
def j9_only_new(spark, d):
    e = table(spark, d, "emails")
    return keyed.only_new(e.where("has_attachments and id is not null"), e.where("not coalesce(has_attachments, false)")).select("id", "pos")


@query("SELECT id, pos FROM emails WHERE id NOT IN (SELECT email_id FROM corrections WHERE email_id IS NOT NULL)")
def k3_delete_keys(spark, d):
    return keyed.delete_keys(table(spark, d, "emails").where("id is not null"), table(spark, d, "corrections").select(F.col("email_id").alias("id"))).select("id", "pos")


@query()
def s15_key_fingerprint(spark, d):
    return keyed.key_fingerprint(table(spark, d, "emails"))


@query("SELECT count(DISTINCT e.id) FILTER (c.id IS NOT NULL) AS kept, count(DISTINCT e.id) FILTER (c.id IS NULL) AS stale FROM (SELECT DISTINCT email_id AS id FROM classifications WHERE email_id IS NOT NULL) e LEFT JOIN (SELECT DISTINCT id FROM emails) c USING (id)")
def j10_stale_keys(spark, d):
    e = classified(spark, d).where("email_id is not null").select(F.col("email_id").alias("id")).distinct()
    ids = table(spark, d, "emails").select("id").distinct().withColumn("there", F.lit(True))
    return e.join(ids, "id", "left").agg(F.count_if("there").alias("kept"), F.count_if(F.col("there").isNull()).alias("stale"))


# ---- text functions
@query(f"{M} SELECT id, lower(trim(regexp_replace(regexp_replace(trim(subject), '^((re|fwd|fw)\\s*:\\s*)+', '', 'i'), '\\s+', ' ', 'g'))) AS subject FROM m")
def f3_normal_subject(spark, d):
    return mails(spark, d).select("id", W.normal_subject(F.col("subject")).alias("subject"))


@query(f"""{M}, x AS (SELECT DISTINCT sender_domain AS domain, string_split(lower(sender_domain), '.') AS p FROM m WHERE sender_domain IS NOT NULL)
    SELECT domain, CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu') THEN array_to_string(p[1:len(p) - 2], '.') WHEN len(p) >= 2 THEN array_to_string(p[1:len(p) - 1], '.') ELSE p[1] END AS name FROM x""")
def f4_domain_names(spark, d):
    return mails(spark, d).where("sender_domain is not null").select(F.col("sender_domain").alias("domain")).distinct().select("domain", W.strip_domain_suffix(F.col("domain")).alias("name"))


@query(f"{M} SELECT id, {_PREFIX} AS prefix FROM m")
def f5_subject_prefix(spark, d):
    return mails(spark, d).select("id", W.subject_prefix(F.col("subject")).alias("prefix"))


@query(f"""{M} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body_text, '(?im)^\\s*system\\s*:', '', 'g'), '(?im)^\\s*assistant\\s*:', '', 'g'),
    '(?im)^\\s*user\\s*:', '', 'g'), '(?im)^\\s*human\\s*:', '', 'g'), '(?i)\\[/?INST\\]', '', 'g'), '(?i)<</?SYS>>', '', 'g'), '(?i)</s>', '', 'g'), '```', '', 'g') AS text FROM m""")
def f20_clean_prompt(spark, d):
    return mails(spark, d).select("id", W.clean_prompt(F.col("body_text"))[0].alias("text"))


@query(f"{M} SELECT DISTINCT category_name, replace(replace(lower(category_name), ' ', '_'), '&', 'and') AS slug FROM categories".replace(M + " ", ""))
def f22_slugs(spark, d):
    return table(spark, d, "categories").select("category_name", W.slug(F.col("category_name")).alias("slug")).distinct()


@query("SELECT id, details_json ->> '$.to' AS target FROM action_log WHERE json_valid(details_json)")
def f16_json_details(spark, d):
    a = table(spark, d, "action_log").withColumn("m", F.from_json("details_json", "map<string,string>"))
    return a.where("m is not null").select("id", F.col("m")["to"].alias("target"))


# ---- relational vocabulary over the other tables
@query("SELECT CAST(window_start AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, * FROM events) GROUP BY 1, 2")
def t7_daily_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT r_name, n_name, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def u8_rollup(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
