"""Queries of the general problems, by name."""

from __future__ import annotations

from postlane.operators.instants import found_instants, mailbox_settings, normalise_instants
from postlane.operators.skew import domain_report, found_hot_domains
from postlane.session import table


def p3_found(spark, d):
    return found_hot_domains(table(spark, d, "emails"))


def p3_domain_report(spark, d):
    return domain_report(table(spark, d, "emails"))


def p6_found(spark, d):
    return found_instants(table(spark, d, "emails"), table(spark, d, "corpus_metadata"))


def p6_instants(spark, d):
    rows = table(spark, d, "emails").select("pos", "mailbox", "received_date")
    return normalise_instants(rows, mailbox_settings(table(spark, d, "corpus_metadata")))


QUERIES = {f.__name__: f for f in (p3_found, p3_domain_report, p6_found, p6_instants)}

_DOMAIN = r"regexp_replace(lower(regexp_replace(sender_domain, '^\s+|\s+$', '', 'g')), '\.$', '')"
SQL = {
    "p3_found": f"""SELECT {_DOMAIN} AS sender_domain FROM emails WHERE sender_domain IS NOT NULL GROUP BY 1
        HAVING count(*) >= 0.04 * (SELECT count(*) FROM emails)""",
    "p3_domain_report": f"""SELECT {_DOMAIN} AS sender_domain, count(*) AS mails, count(DISTINCT id) AS distinct_mails,
        count(DISTINCT lower(sender_email)) AS senders, min(ingested_at) AS first_at, max(ingested_at) AS latest_at,
        CAST(quantile_disc(length(body_text), 0.5) AS BIGINT) AS median_chars, CAST(quantile_disc(length(body_text), 0.9) AS BIGINT) AS p90_chars
        FROM emails GROUP BY 1""",
}
