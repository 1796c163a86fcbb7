"""Statistics over mails: volume, senders, domains, subjects, frequency and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlane.functions import words as W

DAY = 86_400_000_000


def volume(mails: DataFrame, at: str = "ingested_at") -> DataFrame:
    """One row: counts, distinct senders, attachments, mean body length, first and last mail, days and mails a day.

    Days are whole 24 hours between first and last, 1 at least. Without mails the counts are 0, the rest null.
    """
    a = mails.agg(
        F.count(F.lit(1)).alias("total_emails"), F.countDistinct(F.lower("sender_email")).alias("unique_senders"),
        F.coalesce(F.sum(F.when(F.col("has_attachments"), 1)), F.lit(0)).alias("with_attachments"), F.floor(F.avg(F.coalesce(F.length("body_text"), F.lit(0)))).alias("avg_body_length"),
        F.min(at).alias("oldest"), F.max(at).alias("newest"),
    )
    span = F.greatest(F.lit(1), F.floor((F.unix_micros("newest") - F.unix_micros("oldest")) / DAY))
    return a.withColumn("attachment_pct", F.col("with_attachments") * 100.0 / F.col("total_emails")).withColumn("span_days", span).withColumn("emails_per_day", F.col("total_emails") / F.col("span_days"))


def senders(mails: DataFrame, marketing_least: int = 10) -> DataFrame:
    """Per lower-cased address: name, domain, mails, first five subjects, type, first position.

    Subjects are cut to five in partial aggregates of bounded arrays: the five least (pos, subject) of a key are kept
    by rank within (key, bucket) first, so that a sender with most mails is many tasks.
    """
    base = mails.where("sender_email is not null").select(F.lower("sender_email").alias("email"), "sender_name", "subject", "pos")
    counts = base.groupBy("email").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.min_by("sender_name", F.when(F.trim("sender_name") != "", F.col("pos"))).alias("name"))
    bucket = Window.partitionBy("email", F.pmod("pos", F.lit(64))).orderBy("pos")
    few = base.withColumn("r", F.row_number().over(bucket)).where("r <= 5")
    subjects = few.groupBy("email").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "subject"))), lambda x: x["subject"]), 1, 5).alias("sample_subjects"))
    out = counts.join(subjects, "email").withColumn("domain", W.domain_of(F.col("email")))
    text = F.lower(F.array_join(F.col("sample_subjects"), " ", ""))
    kind = (
        F.when(W.contains_any(F.col("email"), W.SERVICE_KEYWORDS), "service").when((F.col("n") > marketing_least) & W.contains_any(text, W.MARKETING_KEYWORDS), "marketing")
        .when(W.contains_any(text, W.WORK_KEYWORDS), "work").otherwise("personal")
    )
    return out.withColumn("type", kind)


def top_senders(mails: DataFrame, n: int = 50) -> DataFrame:
    return senders(mails).orderBy(F.col("n").desc(), "first_pos").limit(n)


def top_values(mails: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The ``n`` most frequent values of a column as they are, ties by first appearance."""
    return mails.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).orderBy(F.col("n").desc(), "first_pos").limit(n)


def subject_prefixes(mails: DataFrame) -> DataFrame:
    p = F.upper(F.regexp_extract("subject", r"(?i)^(re|fwd):", 1))
    return mails.withColumn("p", p).where("p != ''").groupBy(F.concat("p", F.lit(":")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def subject_tokens(mails: DataFrame, tokens, name: str = "token") -> DataFrame:
    """``token, n, first_pos`` of what a function of the subject gives."""
    return mails.select("pos", F.explode(tokens(F.col("subject"))).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def numbered_subjects(mails: DataFrame) -> DataFrame:
    return mails.select(F.explode(W.numbered_patterns(F.col("subject"))).alias("w")).groupBy(W.capitalised(F.col("w")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def keywords(mails: DataFrame, n: int = 50) -> DataFrame:
    """The most frequent words of subjects, ties by first mail, then by word."""
    return subject_tokens(mails, W.subject_words, "keyword").orderBy(F.col("n").desc(), "first_pos", "keyword").limit(n)


def frequency(mails: DataFrame, at: str = "ingested_at", daily: float = 2.0, weekly: float = 8.0, monthly: float = 35.0, least: int = 10) -> DataFrame:
    """Per address as written: how often it writes, by the mean days between its mails."""
    a = mails.groupBy("sender_email").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    gap = (F.unix_micros("last_at") - F.unix_micros("first_at")) / DAY / (F.col("n") - 1)
    label = (
        F.when(F.col("n") == 1, "one-time").when(F.col("n") < least, "occasional").when(F.col("gap") < daily, "daily").when(F.col("gap") < weekly, "weekly")
        .when(F.col("gap") < monthly, "monthly").otherwise("occasional")
    )
    return a.withColumn("gap", F.when(F.col("n") > 1, gap)).withColumn("frequency", label)


def frequency_distribution(mails: DataFrame, **kw) -> DataFrame:
    """All five classes, with 0 where no sender is."""
    spark = mails.sparkSession
    every = spark.createDataFrame([(x,) for x in ("daily", "weekly", "monthly", "occasional", "one-time")], "frequency string")
    return every.join(frequency(mails, **kw).groupBy("frequency").agg(F.count(F.lit(1)).alias("n")), "frequency", "left").select("frequency", F.coalesce("n", F.lit(0)).alias("n"))


def corpus_info(mails: DataFrame, at: str = "ingested_at") -> DataFrame:
    return mails.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sender_email").alias("senders"), F.countDistinct("sender_domain").alias("domains"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def daily_counts(mails: DataFrame, at: str = "ingested_at", last_days: int = 30) -> DataFrame:
    """The last days up to the day of the last mail, with 0 for days without mail."""
    days = mails.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = days.agg(F.max("day").alias("b"), F.min("day").alias("a")).where("b is not null")
    every = ends.select(F.explode(F.sequence(F.greatest(F.col("a"), F.date_sub("b", last_days - 1)), F.col("b"), F.expr("interval 1 day"))).alias("day"))
    return every.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def volume_anomalies(mails: DataFrame, at: str = "ingested_at", sigma: float = 2.0, last_days: int = 30) -> DataFrame:
    """Days whose count lies ``sigma`` population deviations off the mean; none if there are fewer than two days or no deviation."""
    d = daily_counts(mails, at, last_days)
    s = d.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count(F.lit(1)).alias("k"))
    return d.crossJoin(F.broadcast(s)).where("k >= 2 and std > 0").withColumn("z", (F.col("n") - F.col("mean")) / F.col("std")).where(F.abs("z") >= sigma).select("day", "n", "mean", "z")
