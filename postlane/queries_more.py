"""Further queries of the mail operators: sources, suggestions, learning, incremental runs and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlane.functions import texts as T
from postlane.functions import words as W
from postlane.operators import keyed, learning, reports, rules, stats, suggest, vectors
from postlane.operators.instants import mailbox_settings, normalise_instants
from postlane.queries_mail import _R, AS_OF, HALF, KEY, LATEST, RULES, M, classified, mails
from postlane.session import table
from postlane.sources import mailbox, sinks
from postlane.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}
TEMPLATES = [
    suggest.Template("Billing", ("invoice", "rechnung", "factura"), ("ledgerly.example",)), suggest.Template("Meetings", ("meeting", "minutes"), ()), suggest.Template("Alerts", (), ("pingboard.example",)),
    suggest.Template("Shopping", ("order", "delivery"), ("shopwell-mail.example",)),
]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def received(spark, d):
    """The mails with the instant of their own date, whatever its notation."""
    dated = normalise_instants(mails(spark, d), mailbox_settings(table(spark, d, "corpus_metadata")))
    return dated.withColumn("received_at", F.timestamp_micros("utc_micros"))


def clustered(spark, d):
    """The mails with their latest category as cluster."""
    latest = reports.latest_per_mail(classified(spark, d)).select(F.col("email_id").alias("id"), reports.category_key(F.col("category_name")).alias("cluster"))
    return mails(spark, d).join(latest, "id")


_CL = f"{M}, {LATEST}, cl AS (SELECT m.*, {KEY('category_name')} AS cluster FROM m JOIN latest ON latest.email_id = m.id)"


# ---- on the mails' own dates; DuckDB can't read the notations, so these have no SQL (tests compare them with brute force)
@query()
def a1_volume_received(spark, d):
    return stats.volume(received(spark, d), "received_at")


@query()
def a9_frequency_received(spark, d):
    return stats.frequency(received(spark, d).where("received_at is not null"), "received_at")


@query()
def a24_anomalies_received(spark, d):
    return stats.volume_anomalies(received(spark, d), "received_at")


@query()
def a28_corpus_info_received(spark, d):
    return stats.corpus_info(received(spark, d), "received_at")


# ---- top values of groups, order and pages
@query(f"""{_CL}, c AS (SELECT cluster, lower(sender_domain) AS domain, count(*) AS n, min(pos) AS first_pos FROM cl WHERE sender_domain IS NOT NULL GROUP BY 1, 2)
    SELECT cluster, domain, n, first_pos, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_pos, domain) AS rank FROM c QUALIFY rank <= 10""")
def w2_cluster_domains(spark, d):
    return suggest.top_per_group(clustered(spark, d), "cluster", F.lower("sender_domain"), 10, "domain")


@query("SELECT category_id, confidence FROM categories ORDER BY confidence DESC NULLS LAST, category_id LIMIT 5")
def o3_surest_categories(spark, d):
    return table(spark, d, "categories").orderBy(F.col("confidence").desc_nulls_last(), "category_id").limit(5).select("category_id", "confidence")


@query("SELECT category_id, email_count FROM categories ORDER BY email_count DESC NULLS LAST, category_id LIMIT 10")
def o5_review_table(spark, d):
    return reports.sort_categories(table(spark, d, "categories")).limit(10).select("category_id", "email_count")


@query(f"{M} SELECT id, pos FROM m ORDER BY pos LIMIT 50 OFFSET 100")
def o6_page(spark, d):
    return mailbox.page(mails(spark, d), 50, 100).select("id", "pos")


@query("SELECT id, corrected_at FROM corrections ORDER BY corrected_at DESC, id DESC LIMIT 20")
def o8_latest_corrections(spark, d):
    return table(spark, d, "corrections").orderBy(F.col("corrected_at").desc(), F.col("id").desc()).limit(20).select("id", "corrected_at")


@query("SELECT id, action_time FROM action_log WHERE reversible AND success AND action_type <> 'rollback' AND target_id IS NOT NULL ORDER BY action_time DESC, id DESC LIMIT 20")
def o9_newest_rollbacks(spark, d):
    return reports.rollback_candidates(table(spark, d, "action_log")).orderBy(F.col("action_time").desc(), F.col("id").desc()).limit(20).select("id", "action_time")


# ---- sets
@query(f"{_R} SELECT id, id IN (SELECT id FROM h) AS covered FROM m")
def u2_covered_ids(spark, d):
    return rules.evaluate(mails(spark, d), RULES).select("id", (F.size("matched") > 0).alias("covered"))


_TEMPLATE = r"regexp_matches(lower(subject), '(^|[^\p{L}\p{N}_])(invoice|rechnung|factura)($|[^\p{L}\p{N}_])')"


@query(f"{M} SELECT DISTINCT id FROM m WHERE coalesce({_TEMPLATE}, false) OR lower(sender_domain) = 'ledgerly.example' OR ends_with(lower(sender_domain), '.ledgerly.example')")
def u4_matched_ids(spark, d):
    return suggest.matched_ids(mails(spark, d), TEMPLATES[0])


@query(f"SELECT {KEY('category_name')} AS category, list_sort(list(DISTINCT email_id))[1:10] AS ids FROM classifications WHERE email_id IS NOT NULL GROUP BY 1")
def u5_example_ids(spark, d):
    ids = classified(spark, d).where("email_id is not null").select(reports.category_key(F.col("category_name")).alias("category"), "email_id").distinct()
    few = learning.ranked(ids.withColumn("b", F.concat_ws("|", "category", F.pmod(F.xxhash64("email_id"), F.lit(64)))), "b", [F.col("email_id")], 10)
    return few.groupBy("category").agg(F.slice(F.array_sort(F.collect_list("email_id")), 1, 10).alias("ids"))


@query(f"""WITH l AS (SELECT email_id, new_category AS category FROM corrections QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY corrected_at DESC, id DESC) = 1),
    r AS (SELECT category FROM l WHERE email_id IN (SELECT id FROM emails) GROUP BY 1 HAVING count(*) >= 8) SELECT DISTINCT category_name FROM categories WHERE category_name NOT IN (SELECT category FROM r WHERE category IS NOT NULL)""")
def u6_skipped_categories(spark, d):
    trained = reports.training_set(mails(spark, d), table(spark, d, "corrections")).select(F.col("category").alias("category_name")).distinct()
    return table(spark, d, "categories").select("category_name").distinct().join(trained, "category_name", "left_anti")


@query("SELECT 'r1' AS rule_a, 'own' AS rule_b, 2::BIGINT AS shared UNION ALL SELECT 'r2', 'alerts', 1")
def j16_shared_conditions(spark, d):
    c = rules.Condition
    server = [rules.Rule("own", "Billing", (c("subject", "contains", "Invoice"), c("subject", "contains", "faktura"), c("subject", "contains", "quote")), "or"), rules.Rule("alerts", "Alerts", (c("sender_domain", "equals", "pingboard.example"),))]
    return suggest.shared_conditions(suggest.condition_rows(spark, RULES), suggest.condition_rows(spark, server))


# ---- sources
@query(f"{M}, l AS (SELECT lower(user_email) AS box, max(last_extraction_date) AS last FROM corpus_metadata WHERE user_email IS NOT NULL GROUP BY 1) SELECT m.id FROM m LEFT JOIN l ON l.box = lower(trim(m.mailbox)) WHERE last IS NULL OR ingested_at > last")
def t1_new_mails(spark, d):
    return mailbox.since_last(mails(spark, d), table(spark, d, "corpus_metadata")).select("id")


@query("""SELECT CASE WHEN coalesce(trim(id), '') = '' THEN 'no id' WHEN NOT coalesce(contains(sender_email, '@'), false) THEN 'no sender' END AS error, count(*) AS n FROM emails
    WHERE coalesce(trim(id), '') = '' OR NOT coalesce(contains(sender_email, '@'), false) GROUP BY 1""")
def s11_quarantine(spark, d):
    return mailbox.check_rows(table(spark, d, "emails"))[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{M} SELECT id, CASE WHEN trim(coalesce(sender_name, '')) <> '' AND NOT regexp_matches(sender_name, '[<>"]') THEN trim(sender_name) ELSE split_part(coalesce(nullif(trim(sender_email), ''), 'unknown@unknown.com'), '@', 1) END AS name,
    lower(coalesce(nullif(trim(sender_email), ''), 'unknown@unknown.com')) AS email FROM m WHERE sender_email IS NULL OR NOT regexp_matches(sender_email, '[<>]')""")
def s7_from_headers(spark, d):
    """Headers are put together from name and address, and read again; signs of the notation itself are left out of names."""
    m = mails(spark, d).where(F.col("sender_email").isNull() | ~F.col("sender_email").rlike("[<>]"))
    name = F.when(F.col("sender_name").rlike('[<>"]'), "").otherwise(F.coalesce("sender_name", F.lit("")))
    header = F.concat(name, F.lit(" <"), F.coalesce("sender_email", F.lit("")), F.lit(">"))
    return m.select("id", T.parse_sender(header).alias("s")).select("id", "s.name", "s.email")


@query(f"{M} SELECT DISTINCT sender_email, coalesce(list_extract(string_split(sender_email, '@'), 2), 'unknown') AS domain FROM m WHERE sender_email IS NOT NULL")
def s9_domains(spark, d):
    return mails(spark, d).where("sender_email is not null").select("sender_email", W.domain_of(F.col("sender_email")).alias("domain")).distinct()


@query()
def s10_html_text(spark, d):
    """Bodies put into pages, with a script and a style, and read as text again."""
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><p>"), F.replace(F.replace("body_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><script>var x;</script></body></html>"))
    return mails(spark, d).select("id", T.html_to_text(page).alias("text"))


@query("SELECT sha256(string_agg(id, '|' ORDER BY id)) AS hash FROM (SELECT DISTINCT id FROM emails WHERE id IS NOT NULL)")
def s15_id_set_hash(spark, d):
    return spark.createDataFrame([(keyed.id_set_hash(table(spark, d, "emails")),)], "hash string")


@query("SELECT c.category_id, c.category_name, c.description, c.confidence, c.email_count, c.percentage, p.category_name AS parent_name FROM categories c LEFT JOIN categories p ON c.parent_category_id = p.category_id")
def k4_csv_rows(spark, d):
    return sinks.category_rows(table(spark, d, "categories"))


@query("SELECT count(*) AS categories, CAST(sum(coalesce(email_count, 0)) AS BIGINT) AS mails, round(avg(confidence) * 100) AS mean_confidence FROM categories")
def k5_report_summary(spark, d):
    return sinks.summary(table(spark, d, "categories"))


# ---- suggestions
_FIT = f"""{_CL}, s AS (SELECT cluster, subject FROM cl QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY pos) <= 5),
    dm AS (SELECT cluster, dom FROM (SELECT cluster, lower(sender_domain) AS dom, count(*) AS n, min(pos) AS p FROM cl WHERE sender_domain IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, p, dom) <= 10),
    t AS (SELECT * FROM (VALUES ('Billing', '(^|[^\\p{{L}}\\p{{N}}_])(invoice|rechnung|factura)($|[^\\p{{L}}\\p{{N}}_])', 'ledgerly.example'), ('Meetings', '(^|[^\\p{{L}}\\p{{N}}_])(meeting|minutes)($|[^\\p{{L}}\\p{{N}}_])', NULL),
      ('Alerts', NULL, 'pingboard.example'), ('Shopping', '(^|[^\\p{{L}}\\p{{N}}_])(order|delivery)($|[^\\p{{L}}\\p{{N}}_])', 'shopwell-mail.example')) x(template, pattern, domain)),
    fit AS (SELECT template, cluster FROM t JOIN s ON regexp_matches(lower(s.subject), t.pattern) UNION SELECT template, cluster FROM t JOIN dm ON dom = t.domain OR ends_with(dom, '.' || t.domain)),
    hit AS (SELECT template, id FROM fit JOIN cl USING (cluster) UNION SELECT template, id FROM t JOIN cl ON lower(sender_domain) = t.domain OR ends_with(lower(sender_domain), '.' || t.domain)),
    tot AS (SELECT count(*) AS total FROM cl)"""


@query(f"{_FIT} SELECT template, count(*) AS n, count(*) * 100.0 / any_value(total) AS pct, greatest(0.1, least(0.9, 2 * (count(*) * 100.0 / any_value(total)) / 100)) AS confidence FROM hit, tot GROUP BY 1")
def m10_match_templates(spark, d):
    return suggest.match_templates(clustered(spark, d), TEMPLATES)


_OV = f"""WITH s AS (SELECT DISTINCT {KEY('category_name')} AS category, email_id AS id FROM classifications WHERE email_id IS NOT NULL), n AS (SELECT category, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.category AS a, y.category AS b, count(*) AS b2 FROM s x JOIN s y ON x.id = y.id AND x.category < y.category GROUP BY 1, 2),
    o AS (SELECT a, b, b2 / (na.n + nb.n - b2) AS jaccard FROM p JOIN n na ON na.category = a JOIN n nb ON nb.category = b)"""


def _overlaps(spark, d):
    c = classified(spark, d).where("email_id is not null")
    return reports.overlaps(c.select(reports.category_key(F.col("category_name")).alias("category"), F.col("email_id").alias("id")))


@query(f"{_OV} SELECT a, b, jaccard FROM o WHERE jaccard >= 0.01")
def m13_merge_candidates(spark, d):
    return suggest.merge_candidates(_overlaps(spark, d), 0.01).select("a", "b", "jaccard")


@query(f"""{_OV}, u AS (SELECT a AS category, jaccard FROM o UNION ALL SELECT b, jaccard FROM o), g AS (SELECT category, sum(jaccard) AS s FROM u GROUP BY 1)
    SELECT n.category, 1 - coalesce(s / ((SELECT count(*) FROM n) - 1), 0) AS distinctiveness FROM n LEFT JOIN g USING (category)""")
def m13_distinctiveness(spark, d):
    names = classified(spark, d).where("email_id is not null").select(reports.category_key(F.col("category_name")).alias("category")).distinct()
    return suggest.distinctiveness(names, _overlaps(spark, d))


_STOP = ", ".join(f"'{w}'" for w in W.STOP_WORDS)
_WORDS = f"""w AS (SELECT cluster, pos, word FROM (SELECT cluster, pos, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(subject, '^re:\\s*', '', 'i'), '^fwd:\\s*', '', 'i'),
    '[\\[\\(][^\\]\\)]+[\\]\\)]', '', 'g'), '[\\p{{L}}\\p{{N}}_]+\\s*[#№]\\s*\\d+', '', 'g')), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM cl) WHERE regexp_full_match(word, '[a-z]{{2,}}') AND word NOT IN ({_STOP}))"""


@query(f"""{_CL}, {_WORDS}, a AS (SELECT cluster, word AS value, count(*) AS n, min(pos) AS p FROM w GROUP BY 1, 2), b AS (SELECT cluster, lower(sender_domain) AS value, count(*) AS n, min(pos) AS p FROM cl WHERE sender_domain IS NOT NULL GROUP BY 1, 2)
    SELECT cluster AS category, 'subject' AS field, 'contains' AS operator, value, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, p, value) AS ord FROM a QUALIFY ord <= 5
    UNION ALL SELECT cluster, 'sender_domain', 'equals', value, 5 + row_number() OVER (PARTITION BY cluster ORDER BY n DESC, p, value) AS ord FROM b QUALIFY ord <= 8""")
def m16_rule_conditions(spark, d):
    return suggest.rule_conditions(clustered(spark, d).withColumnRenamed("cluster", "category"))


@query(f"""{_CL}, {_WORDS}, c AS (SELECT cluster, word AS term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT cluster, sqrt(sum(CAST(tf AS DOUBLE) * tf)) AS length FROM c GROUP BY 1)
    SELECT c.cluster, term, tf / length AS score, row_number() OVER (PARTITION BY c.cluster ORDER BY tf DESC, term) AS rank FROM c JOIN l ON l.cluster = c.cluster QUALIFY rank <= 10""")
def m9_cluster_names(spark, d):
    return suggest.cluster_names(clustered(spark, d))


# ---- learning
def decisions(spark, d):
    """Corrections read as decisions of reviewers: their kind goes by number, their confidence is the weight's half."""
    kind = F.element_at(F.array(*map(F.lit, ("rename", "merge", "delete", "accept"))), (F.col("id") % 4 + 1).cast("int"))
    return table(spark, d, "corrections").select(kind.alias("action"), reports.category_key(F.col("old_category")).alias("old"), reports.category_key(F.col("new_category")).alias("new"), (F.col("weight") / 2).alias("confidence"), F.col("corrected_at").alias("decided_at"))


_DEC = f"""WITH d AS (SELECT ['rename', 'merge', 'delete', 'accept'][id % 4 + 1] AS action, {KEY('old_category')} AS old, {KEY('new_category')} AS new, weight / 2 AS confidence, corrected_at AS decided_at FROM corrections)"""
#: Half-life long enough for decisions of three years to count.
LIFE = 720


@query(f"""{_DEC}, k AS (SELECT *, CASE WHEN action IN ('rename', 'merge') THEN action WHEN action = 'accept' THEN 'always_accept' WHEN action = 'delete' AND confidence <= 0.4 THEN 'delete_low_confidence' END AS kind,
    pow(2.0, -greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(decided_at)) / 86400000000) / {LIFE}.0) AS w FROM d),
    f AS (SELECT kind, CASE WHEN kind <> 'delete_low_confidence' THEN old END AS old, CASE WHEN kind IN ('rename', 'merge') THEN new END AS new, w, confidence FROM k WHERE kind IS NOT NULL AND NOT coalesce(kind IN ('rename', 'merge') AND (old IS NULL OR new IS NULL OR old = new), false)),
    g AS (SELECT kind, old, new, count(*) AS n, sum(w) AS weight, avg(confidence) AS mean FROM f GROUP BY 1, 2, 3)
    SELECT kind, old, new, n, weight, least(0.5 + 0.2 * CASE WHEN weight > 1 THEN log2(weight) ELSE 0 END, 0.99) AS confidence, CASE WHEN kind = 'delete_low_confidence' THEN round(mean + 0.05, 2) END AS threshold FROM g WHERE weight >= 1 - 1e-6""")
def a21_decision_patterns(spark, d):
    return learning.decision_patterns(decisions(spark, d), F.lit(AS_OF).cast("timestamp"), LIFE, 1.0)


@query(f"""{_DEC} SELECT category, sum(s) AS score FROM (SELECT CASE WHEN action = 'rename' THEN new ELSE old END AS category, CASE WHEN action IN ('accept', 'rename') THEN 1.0::DOUBLE WHEN action = 'delete' THEN -1.0 END AS s FROM d)
    WHERE s IS NOT NULL AND category IS NOT NULL GROUP BY 1""")
def a22_decision_scores(spark, d):
    return learning.decision_scores(decisions(spark, d))


@query(f"""{_R}, g AS (SELECT id, arg_min(rule_id, (-x, o)) AS rule_id FROM (SELECT h.*, coalesce(s.score, 0) AS x FROM h LEFT JOIN (SELECT {KEY('new_category')} AS category, CAST(count(*) AS DOUBLE) AS score FROM corrections GROUP BY 1) s ON s.category = lower(h.category)) GROUP BY id) SELECT id, rule_id FROM g""")
def m18_resolve_by_history(spark, d):
    history = table(spark, d, "corrections").groupBy(reports.category_key(F.col("new_category")).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    names = spark.createDataFrame(sorted({(r.category, r.category.lower()) for r in RULES}), "category string, k string")
    return rules.resolve(mails(spark, d), RULES, ("historical",), names.join(history, "k").select("category", "score")).select("id", "rule_id")


@query(f"""{_R}, g AS (SELECT id, arg_min(category, o) AS category, arg_min(rule_id, o) AS rid, arg_min(priority, o) AS p FROM h GROUP BY id), {LATEST}
    SELECT m.id, CASE WHEN g.id IS NOT NULL THEN g.category WHEN l.confidence >= 0.6 THEN l.category_name ELSE 'Uncategorized' END AS category,
    CASE WHEN g.id IS NOT NULL THEN 0.1 + least(p / 100.0, 1.0) * 0.9 WHEN l.confidence >= 0.6 THEN l.confidence ELSE 0.0 END AS confidence,
    CASE WHEN g.id IS NOT NULL THEN 'rule:' || rid WHEN l.confidence >= 0.6 THEN 'classifier:latest' ELSE 'none' END AS source FROM m LEFT JOIN g USING (id) LEFT JOIN latest l ON l.email_id = m.id""")
def m19_with_classifier(spark, d):
    return learning.with_classifier(rules.categorise(mails(spark, d), RULES), reports.latest_per_mail(classified(spark, d)), "latest")


_PER_SOURCE = "l AS (SELECT email_id, source, category_name, confidence FROM classifications WHERE email_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY email_id, source ORDER BY classified_at DESC, id DESC) = 1)"


@query(f"""WITH {_PER_SOURCE}, o AS (SELECT * FROM (VALUES ('setfit', 0, 0.8), ('llm', 1, 0.7), ('rule', 2, 0.9)) x(source, place, least_c)), r AS (SELECT l.*, place, confidence >= least_c AS passed FROM l JOIN o USING (source) WHERE confidence IS NOT NULL)
    SELECT email_id, category_name AS category, confidence, 'ensemble:' || source AS source FROM r QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY passed DESC, CASE WHEN passed THEN place ELSE -confidence END, place) = 1""")
def m23_ensemble(spark, d):
    c = classified(spark, d).where("email_id is not null")
    last = c.groupBy("email_id", "source").agg(F.max_by(F.struct("category_name", "confidence"), F.struct("classified_at", "id")).alias("x")).select("email_id", "source", "x.*")
    return learning.ensemble(last, [("setfit", 0.8), ("llm", 0.7), ("rule", 0.9)])


@query()
def m20_classify(spark, d):
    """Classified by a provider; here one that needs no network: the first allowed category whose word stands in the text."""
    allowed = ["Billing", "Delivery", "Meeting"]

    def provider():
        return lambda texts: [next((learning.Answer(c, 0.8) for c in allowed if c.lower() in t.lower()), learning.Answer("Other", 0.9)) for t in texts]

    return learning.classify(mails(spark, d), provider, allowed)


@query()
def m22_few_shot(spark, d):
    model, _ = learning.few_shot(reports.training_set(mails(spark, d), table(spark, d, "corrections")))
    rows = mails(spark, d).select("id", F.concat_ws(" ", "subject", "body_text").alias("text"))
    return model.transform(rows).select("id", "predicted") if model else rows.select("id", F.lit(None).cast("string").alias("predicted"))


@query(f"""{_CL}, e AS (SELECT id FROM cl WHERE ingested_at < TIMESTAMP '{HALF}'), g AS (SELECT cluster, count(*) AS n, count(*) FILTER (id NOT IN (SELECT id FROM e)) AS n_new FROM cl GROUP BY 1) SELECT cluster, n, n_new FROM g WHERE n_new >= 10 AND n_new / n > 0.5""")
def a25_emerging_clusters(spark, d):
    m = clustered(spark, d)
    return learning.emerging_topics(m, m.where(F.col("ingested_at") < F.lit(HALF).cast("timestamp"))).select("cluster", "n", "n_new")


@query()
def a25_emerging_topic_names(spark, d):
    m = clustered(spark, d)
    return learning.emerging_topics(m, m.where(F.col("ingested_at") < F.lit(HALF).cast("timestamp")))


@query("SELECT count(*) AS n, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (reversible) AS reversible FROM action_log")
def a26_action_totals(spark, d):
    return table(spark, d, "action_log").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if("reversible").alias("reversible"))


@query(f"{M} SELECT count(*) AS entries, count(*) FILTER (c.id IS NOT NULL) AS hits, count(*) FILTER (c.id IS NOT NULL) / count(*) AS hit_rate FROM m LEFT JOIN (SELECT DISTINCT email_id AS id FROM classifications WHERE model_version = 'v2') c USING (id)")
def a30_cache_stats(spark, d):
    cache = classified(spark, d).select("email_id", F.col("model_version").alias("model"), F.lit(64).alias("dim"), F.lit(1500).alias("text_len"))
    ids = mails(spark, d).select(F.col("id").alias("email_id"))
    hit, _ = mailbox.cache_parts(ids, cache, F.lit("v2"), F.lit(64), F.lit(1500))
    return ids.agg(F.count(F.lit(1)).alias("entries")).crossJoin(hit.agg(F.count(F.lit(1)).alias("hits"))).withColumn("hit_rate", F.col("hits") / F.col("entries"))


@query(f"{M}, {LATEST} SELECT round(count(*) FILTER (l.email_id IS NOT NULL AND {KEY('category_name')} <> 'uncategorized') * 100.0 / count(*), 1) AS coverage, count(*) FILTER (l.email_id IS NULL OR {KEY('category_name')} = 'uncategorized') AS uncategorized FROM m LEFT JOIN latest l ON l.email_id = m.id")
def a31_run_report(spark, d):
    m = mails(spark, d)
    open_ = reports.uncategorised(m, reports.latest_per_mail(classified(spark, d)))
    j = m.agg(F.count(F.lit(1)).alias("n")).crossJoin(open_.agg(F.count(F.lit(1)).alias("uncategorized")))
    return j.select(F.round((F.col("n") - F.col("uncategorized")) * 100.0 / F.col("n"), 1).alias("coverage"), "uncategorized")


# ---- incremental
@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), cc AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY 1),
    a AS (SELECT vec_id, arg_max(label, (s, -label)) AS label FROM (SELECT vec_id, cc.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, cc) GROUP BY 1),
    j AS (SELECT label, count(*) AS n FROM (SELECT label FROM embeddings UNION ALL SELECT label FROM a) GROUP BY 1) SELECT label, n, round(n * 100.0 / (SELECT sum(n) FROM j), 2) AS pct FROM j""")
def m8_reassigned_sizes(spark, d):
    v = table(spark, d, "embeddings")
    return incremental.merge_sizes(v.groupBy("label").agg(F.count(F.lit(1)).alias("n")), vectors.assign_nearest(v, vectors.centroids(v)))


@query()
def m3_elbow_and_silhouette(spark, d):
    return vectors.cluster_report(table(spark, d, "embeddings"), [4, 8, 10, 12])


@query("""SELECT a.vec_id, a.label, m.a, m.b, CASE WHEN m.a IS NULL OR m.b IS NULL THEN 0 ELSE (m.b - m.a) / greatest(m.a, m.b) END AS silhouette FROM embeddings a JOIN (SELECT vec_id, max(CASE WHEN same AND k > 0 THEN s / k END) AS a, min(CASE WHEN NOT same THEN s / k END) AS b FROM
    (SELECT x.vec_id, x.label = y.label AS same, y.label AS other, sum(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS s, count(*) - CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS k FROM embeddings x, embeddings y GROUP BY x.vec_id, x.label, y.label) GROUP BY 1) m USING (vec_id)""")
def m5_exact_silhouettes(spark, d):
    return vectors.exact_silhouettes(table(spark, d, "embeddings"))


# ---- column functions
@query(f"{M} SELECT id, substring(body_text, 1, 200) AS preview, substring(subject, 1, 50) AS title FROM m")
def f2_previews(spark, d):
    return mails(spark, d).select("id", F.substring("body_text", 1, 200).alias("preview"), F.substring("subject", 1, 50).alias("title"))


@query("SELECT id, CAST(round_even(confidence * 100, 0) AS BIGINT) AS priority FROM classifications")
def f8_priorities(spark, d):
    return classified(spark, d).select("id", F.bround(F.col("confidence") * 100, 0).cast("bigint").alias("priority"))


@query("SELECT id, 1 / (1 + exp(-5 * (confidence - 0.5))) AS probability, CASE WHEN 1 / (1 + exp(-5 * (confidence - 0.5))) > 0.7 THEN 'strong' WHEN 1 / (1 + exp(-5 * (confidence - 0.5))) >= 0.4 THEN 'moderate' ELSE 'weak' END AS label FROM classifications")
def f9_strength(spark, d):
    return classified(spark, d).select("id", T.strength(F.col("confidence") - 0.5).alias("s")).select("id", "s.*")


@query("SELECT id, CASE WHEN json_valid(details_json) THEN details_json ->> '$.to' END AS target FROM action_log WHERE details_json IS NOT NULL")
def f17_fenced_answers(spark, d):
    a = table(spark, d, "action_log").where("details_json is not null")
    fenced = F.concat(F.lit("```json\n"), F.col("details_json"), F.lit("\n```"))
    return a.select("id", F.get_json_object(T.without_fence(fenced), "$.to").alias("target"))


@query("SELECT category_id, sha256(category_name) AS hash FROM categories")
def f18_sha256(spark, d):
    return table(spark, d, "categories").select("category_id", F.sha2("category_name", 256).alias("hash"))


@query()
def f19_name_similarity(spark, d):
    c = table(spark, d, "categories")
    p = c.select(F.col("category_id").alias("pid"), F.col("category_name").alias("parent"))
    return c.join(p, F.col("parent_category_id") == F.col("pid")).select("category_id", T.name_similarity("category_name", "parent").alias("similarity"))


@query(f"{M} SELECT id, '<subject>' || replace(replace(replace(coalesce(subject, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</subject>' AS text FROM m")
def f21_wrapped(spark, d):
    return mails(spark, d).select("id", T.wrapped("subject", F.col("subject")).alias("text"))


@query(f"{M} SELECT id, coalesce(regexp_full_match(sender_email, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}'), false) AS valid FROM m")
def f24_valid_addresses(spark, d):
    return mails(spark, d).select("id", T.is_address(F.col("sender_email")).alias("valid"))


@query("SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END AS level FROM classifications")
def f25_levels(spark, d):
    return classified(spark, d).select("id", T.confidence_level(F.col("confidence")).alias("level"))


@query(f"{M} SELECT id, replace(replace(lower(sender_email), '@', '_at_'), '.', '_') AS slug FROM m")
def f22_address_slugs(spark, d):
    return mails(spark, d).select("id", W.address_slug(F.lower("sender_email")).alias("slug"))


@query(f"{M} SELECT id, coalesce(lower(sender_domain) = 'brontide.example' OR ends_with(lower(sender_domain), '.brontide.example'), false) AS inside FROM m")
def p13_domain_match(spark, d):
    return mails(spark, d).select("id", suggest.domain_in(F.col("sender_domain"), ("brontide.example",)).alias("inside"))


@query(f"{M} SELECT id, coalesce({_TEMPLATE}, false) AS hit FROM m")
def p14_keyword_match(spark, d):
    return mails(spark, d).select("id", T.has_keyword(F.col("subject"), ["invoice", "rechnung", "factura"]).alias("hit"))


@query(f"{M} SELECT id FROM m WHERE ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def p15_last_days(spark, d):
    return mails(spark, d).where(F.col("ingested_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 30 days")).select("id")


@query(f"""{M}, {LATEST} SELECT (SELECT count(*) FROM emails WHERE id IS NOT NULL) - (SELECT count(*) FROM m) AS repeated_ids, (SELECT count(*) FROM latest WHERE email_id NOT IN (SELECT id FROM m)) AS unknown_ids,
    (SELECT sum(percentage) BETWEEN 98 AND 102 FROM categories) AS shares_add_up""")
def p17_validation(spark, d):
    e = table(spark, d, "emails").where("id is not null")
    repeated = e.agg((F.count(F.lit(1)) - F.countDistinct("id")).alias("repeated_ids"))
    unknown = reports.latest_per_mail(classified(spark, d)).join(e.select(F.col("id").alias("email_id")), "email_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ids"))
    shares = table(spark, d, "categories").agg(F.sum("percentage").between(98, 102).alias("shares_add_up"))
    return repeated.crossJoin(unknown).crossJoin(shares)


@query("SELECT category_id, category_name FROM categories WHERE confidence > 0.6 OR category_id IN (SELECT parent_category_id FROM categories WHERE confidence > 0.6)")
def p10_filter_by_confidence(spark, d):
    return reports.filter_categories(table(spark, d, "categories"), "confidence:>60").select("category_id", "category_name")


@query("SELECT category_id, category_name FROM categories WHERE contains(lower(category_name), 'order') OR contains(lower(description), 'order') OR category_id IN (SELECT parent_category_id FROM categories WHERE contains(lower(category_name), 'order') OR contains(lower(description), 'order'))")
def p10_filter_by_text(spark, d):
    return reports.filter_categories(table(spark, d, "categories"), " Order ").select("category_id", "category_name")


@query("""WITH w AS (SELECT pos, ord, trim(x) AS name FROM (SELECT pos, pos AS ord, sender_name AS x FROM emails)), f AS (SELECT lower(name) AS k, arg_min(name, ord) AS name FROM w WHERE name <> '' GROUP BY 1),
    e AS (SELECT lower(trim(category_name)) AS k, min(trim(category_name)) AS there FROM categories GROUP BY 1) SELECT coalesce(there, name) AS name, CASE WHEN there IS NOT NULL THEN 'exists' ELSE 'create' END AS status FROM f LEFT JOIN e USING (k)""")
def x6_ensure_folders(spark, d):
    wanted = table(spark, d, "emails").select(F.col("pos").alias("ord"), F.col("sender_name").alias("name"))
    return reports.ensure_folders(wanted, table(spark, d, "categories").select(F.col("category_name").alias("name")))


@query(f"""WITH {LATEST}, f AS (SELECT {KEY('category_name')} AS k, min(category_id) AS folder FROM categories GROUP BY 1) SELECT email_id, folder FROM latest LEFT JOIN f ON f.k = {KEY('latest.category_name')}""")
def j19_folder_plan(spark, d):
    folders = table(spark, d, "categories").groupBy(reports.category_key(F.col("category_name")).alias("k")).agg(F.min("category_id").alias("folder"))
    return reports.latest_per_mail(classified(spark, d)).withColumn("k", reports.category_key(F.col("category_name"))).join(folders, "k", "left").select("email_id", "folder")
