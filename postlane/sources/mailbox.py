"""Readers of mail exports: JSON corpora, JSON lines, provider messages; bad rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.functions import texts as T
from postlane.functions import words as W
from postlane.operators.keyed import first_per_key

EMAIL = (
    "id string, sender_email string, sender_name string, recipient_email string, recipient_name string, subject string, body_text string, received_date string, has_attachments boolean, "
    "thread_id string, in_reply_to string, references array<string>"
)
CORPUS = f"extraction_metadata struct<extraction_date:string,total_emails:bigint,source:string,user_email:string>, emails array<struct<{EMAIL.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array<', ':array<').replace(', ', ',')}>>"
GMAIL = (
    "id string, threadId string, internalDate string, payload struct<headers:array<struct<name:string,value:string>>,parts:array<struct<filename:string,mimeType:string,body:struct<data:string>>>,mimeType:string,body:struct<data:string>>"
)
GRAPH = (
    "id string, subject string, receivedDateTime string, hasAttachments boolean, from struct<emailAddress:struct<name:string,address:string>>, "
    "toRecipients array<struct<emailAddress:struct<name:string,address:string>>>, body struct<contentType:string,content:string>"
)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(emails, metadata)`` of files that hold one JSON object each: ``extraction_metadata`` and ``emails``.

    ``pos`` numbers the mails by file and place, without a shuffle: the file's name hash and the place within it.
    """
    raw = spark.read.schema(CORPUS).json(path, multiLine=True).withColumn("file", F.input_file_name())
    mails = raw.select("file", F.posexplode("emails").alias("place", "e")).select("file", "place", "e.*")
    return mails.withColumn("sender_domain", W.domain_of(F.col("sender_email"))), raw.select("file", "extraction_metadata.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantine)`` of JSON lines: rows that fit the schema, and the text of those that don't."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select(F.col("value").alias("line"), F.lit("malformed").alias("error"))


def check_rows(mails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``: mails without an id or without an address of the sender are set apart with the reason."""
    reason = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(~F.coalesce(F.col("sender_email").contains("@"), F.lit(False)), "no sender")
    marked = mails.withColumn("error", reason)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def from_gmail(messages: DataFrame) -> DataFrame:
    """Gmail messages (schema ``GMAIL``) in the common shape.

    Header names count without case. Without a subject it is "(No subject)"; references are split at white space; a mail has
    attachments if one of its parts has a file name; the date is the header's, ``internal_date`` the milliseconds of arrival.
    """
    value = lambda name: F.get(F.transform(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(0))
    sender, to = T.parse_sender(value("from")), T.parse_sender(F.split(value("to"), ",")[0])
    return messages.select(
        "id", sender["email"].alias("sender_email"), sender["name"].alias("sender_name"), W.domain_of(sender["email"]).alias("sender_domain"), F.when(value("to").isNotNull(), to["email"]).alias("recipient_email"),
        F.when(value("to").isNotNull(), to["name"]).alias("recipient_name"), F.coalesce(value("subject"), F.lit("(No subject)")).alias("subject"), T.mime_text(F.to_json("payload")).alias("body_text"), value("date").alias("received_date"),
        F.coalesce(F.exists("payload.parts", lambda p: F.coalesce(p["filename"], F.lit("")) != ""), F.lit(False)).alias("has_attachments"), F.col("threadId").alias("thread_id"), value("in-reply-to").alias("in_reply_to"),
        F.filter(F.split(F.coalesce(value("references"), F.lit("")), r"\s+"), lambda x: x != "").alias("references"), F.col("internalDate").try_cast("bigint").alias("internal_date"),
    )


def from_graph(messages: DataFrame) -> DataFrame:
    """Graph messages (schema ``GRAPH``) in the common shape; the first recipient counts, and HTML bodies become text."""
    sender, to = F.col("from.emailAddress"), F.get("toRecipients", F.lit(0))["emailAddress"]
    body = F.when(F.lower("body.contentType") == "html", T.html_to_text(F.col("body.content"))).otherwise(F.col("body.content"))
    email = F.lower(F.coalesce(sender["address"], F.lit("unknown@unknown.com")))
    return messages.select(
        "id", email.alias("sender_email"), F.coalesce(sender["name"], F.split(email, "@")[0]).alias("sender_name"), W.domain_of(email).alias("sender_domain"), F.lower(to["address"]).alias("recipient_email"), to["name"].alias("recipient_name"),
        F.coalesce("subject", F.lit("(No subject)")).alias("subject"), body.alias("body_text"), F.col("receivedDateTime").alias("received_date"), F.coalesce("hasAttachments", F.lit(False)).alias("has_attachments"),
    )


def since_last(mails: DataFrame, metadata: DataFrame, at: str = "ingested_at") -> DataFrame:
    """The mails of each mailbox after its ``last_extraction_date``; a mailbox without one gives all. ``metadata`` has one row a mailbox."""
    last = metadata.where("user_email is not null").groupBy(F.lower("user_email").alias("__box")).agg(F.max("last_extraction_date").alias("__last"))
    j = mails.withColumn("__box", F.lower(F.trim("mailbox"))).join(last, "__box", "left")
    return j.where(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__box", "__last")


def page(rows: DataFrame, limit: int, offset: int = 0, order: str = "pos") -> DataFrame:
    """``limit`` rows from ``offset`` on, in order."""
    return rows.orderBy(order).offset(offset).limit(limit)


def migrate(mails: DataFrame, path: str) -> DataFrame:
    """Writes the valid mails, the first of each id, as Parquet, and gives one row of counts; repeated runs give the same table."""
    valid, bad = check_rows(mails)
    first_per_key(valid).write.mode("overwrite").parquet(path)
    done = mails.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("migrated"))
    return done.crossJoin(bad.agg(F.count(F.lit(1)).alias("skipped")))


def cache_parts(ids: DataFrame, cache: DataFrame, model: Column, dim: Column, text_length: Column, key: str = "email_id") -> tuple[DataFrame, DataFrame]:
    """``(cached, missing)`` ids: a vector counts only if model, dimension and text length are as asked for."""
    fit = cache.where((F.col("model") == model) & (F.col("dim") == dim) & (F.col("text_len") == text_length)).select(key)
    return ids.join(fit, key, "left_semi"), ids.join(fit, key, "left_anti")
