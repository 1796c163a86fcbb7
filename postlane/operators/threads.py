"""Threads: reply links, header components and subject windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlane.functions.words import normal_subject
from postlane.operators.graph import connected_components

DAY = 86_400_000_000
# What stands for "no value" in header fields.
NONE_WORDS = ["", "null", "none", "undefined", "n/a", "0"]


def header_names(c):
    tokens = F.regexp_extract_all(c, F.lit(r"[^\s\"'<>\[\]{},;\\]+"), F.lit(0))
    return F.coalesce(F.filter(tokens, lambda t: ~F.lower(t).isin(NONE_WORDS)), F.array())


def parent_links(mails: DataFrame) -> DataFrame:
    """``id, parent``: in_reply_to if such a mail exists, else the last reference that exists (names by id only)."""
    given = mails.select(
        "id", F.posexplode(F.concat(F.transform("references", lambda x: F.struct(F.lit(0).alias("rank"), x.alias("name"))), F.when(F.col("reply").isNotNull(), F.array(F.struct(F.lit(1).alias("rank"), F.col("reply").alias("name")))).otherwise(F.array().cast("array<struct<rank:int,name:string>>")))).alias("at", "g")
    ).select("id", "at", "g.rank", "g.name")
    ids = mails.select(F.col("id").alias("name")).distinct()
    return given.join(ids, "name").where("name != id").groupBy("id").agg(F.max_by("name", F.struct("rank", "at")).alias("parent"))


def header_threads(mails: DataFrame) -> DataFrame:
    """``id, thread``: components over reply links, named by their least id; mails without link aren't in it."""
    c = connected_components(parent_links(mails).select(F.col("id").alias("a"), F.col("parent").alias("b")))
    return c.select(F.col("node").alias("id"), F.col("component").alias("thread"))


def anchored_windows(rows: DataFrame, days: int = 7) -> DataFrame:
    """``id, thread``: within (subject, domain), mails up to ``days`` after the first mail of a window belong to it.

    Windows start anew with the first mail past the last one. Rows have ``id, key, micros``. A window holds only
    mails of ``days`` days, so a key is first cut where a gap of more than ``days`` starts a window for certain; what
    lies between two such gaps is folded in order.
    """
    gap = Window.partitionBy("key").orderBy("micros", "id")
    cut_at = F.coalesce((F.col("micros") - F.lag("micros").over(gap)) > days * DAY, F.lit(True))
    islands = rows.withColumn("start", cut_at.cast("int")).withColumn("island", F.sum("start").over(gap))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["micros", "id"])
        first, name, names = None, None, []
        for i, m in zip(part["id"], part["micros"]):
            if first is None or m - first > days * DAY:
                first, name = m, i
            names.append(name)
        return pd.DataFrame({"id": part["id"], "thread": names})

    return islands.groupBy("key", "island").applyInPandas(fold, "id string, thread string")


def threads(mails: DataFrame, days: int = 7) -> DataFrame:
    """``id, thread``: header threads first, what is left by subject, sender domain and ``days`` days."""
    by_header = header_threads(mails)
    rest = mails.join(by_header.select("id"), "id", "left_anti").select(
        "id", F.concat_ws("\x01", normal_subject(F.coalesce("subject", F.lit(""))), F.lower(F.coalesce("sender_domain", F.lit("")))).alias("key"), F.unix_micros("ingested_at").alias("micros")
    )
    return by_header.unionByName(anchored_windows(rest, days))


def thread_rollup(mails: DataFrame, of: DataFrame) -> DataFrame:
    """Per thread: mails, participants, first subject, first and last time, and whether it is a conversation."""
    j = mails.join(of, "id")
    return j.groupBy("thread").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("sender_email")).alias("participants"), F.min_by("subject", F.struct("ingested_at", "pos")).alias("subject"),
        F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"),
    ).withColumn("kind", F.when(F.col("n") > 1, "conversation").otherwise("single"))
