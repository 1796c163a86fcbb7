"""Problem 6: one UTC instant for every date notation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.functions.instants import CANONICAL, add_wall_time, table_time, zone_names, zone_table


def normalise_instants(
    rows: DataFrame, mailboxes: DataFrame, text: str = "received_date", mailbox: str = "mailbox"
) -> DataFrame:
    """Adds ``utc_micros`` (long), ``zone_status`` and ``is_canonical`` to ``rows``.

    The wall time is parsed inside the JVM, then joined as of its zone's offset intervals: the intervals are
    exploded by wall-clock year, so the join is an equality on (zone, year) and the match within a year reads at
    most a handful of intervals. Two intervals that hold the wall time mean ``ambiguous`` (the first instant is
    taken), none means ``nonexistent`` (the offset before the change is taken), one gives the offset directly.
    Texts with their own offset are ``offset``, epoch counts ``epoch``.

    ``mailboxes`` has ``mailbox`` (any case), ``time_zone`` and ``date_order``; it holds one row per mailbox, and
    its size is left to Spark's own broadcast threshold. The interval table holds the zones that occur and the years 1800 to
    2127, is bounded by the IANA list and broadcast; earlier years have each zone's first offset, later ones the changes of a
    year with the same calendar, so every year is exact.

    Null, empty and unreadable texts, and texts without zone from a mailbox that isn't known, give null. Extra
    columns pass through; columns of ``rows`` named like an added one are replaced. Repeated rows stay.
    """
    spark = rows.sparkSession
    added = ("utc_micros", "zone_status", "is_canonical")
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in added])
    boxes = (
        mailboxes.where(F.col("mailbox").isNotNull())
        .select(F.lower(F.trim("mailbox")).alias("__box"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order"))
        .groupBy("__box").agg(F.min("__tz").alias("__tz"), F.min("__order").alias("__order"))
    )
    placed = rows.withColumn("__box", F.lower(F.trim(F.col(f"`{mailbox}`")))).join(boxes, "__box", "left")
    parsed = (
        add_wall_time(placed, F.col(f"`{text}`"), F.col("__order"))
        .withColumn("__zone", F.when(F.col("__wall").isNotNull() & F.col("__own").isNull(), F.coalesce("__zone", "__tz")))
        .withColumns(dict(zip(("__year", "__in_table"), table_time(F.col("__wall")))))
    )
    known = sorted(zone_names())
    named = rows.select(F.regexp_extract(F.col(f"`{text}`"), r"\[([A-Za-z_]+/[A-Za-z0-9_+/-]+)\]", 1).alias("z")).unionByName(boxes.select(F.col("__tz").alias("z")))
    used = [r.z for r in named.where(F.col("z").isin(known)).distinct().collect()]  # no more than the IANA list
    spans = zone_table(spark, used).select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))
    joined = parsed.join(F.broadcast(spans), ["__zone", "__year"], "left")
    wall, own, epoch, near, exact = (F.col(c) for c in ("__wall", "__own", "__epoch", "__near", "__exact"))
    moved = F.col("__in_table")
    joined = joined.withColumn("__near", F.filter("__spans", lambda x: (x["lo"] <= moved) & (moved < x["reach"])))
    joined = joined.withColumn("__exact", F.filter(near, lambda x: moved < x["hi"]))
    held = F.transform(F.when(F.size(exact) > 0, exact).otherwise(near), lambda x: x["offset_s"])
    status = (
        F.when(epoch.isNotNull(), "epoch").when(wall.isNull(), None).when(own.isNotNull(), "offset")
        .when(F.coalesce(F.size(near), F.lit(0)) <= 0, None).when(F.size(exact) == 0, "nonexistent").when(F.size(exact) > 1, "ambiguous").otherwise("unique")
    )
    utc = F.when(epoch.isNotNull(), epoch).when(own.isNotNull(), wall - own * 1_000_000).when(F.size(near) > 0, wall - F.array_max(held) * 1_000_000)
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        utc.alias("utc_micros"),
        status.alias("zone_status"),
        F.coalesce(F.col(f"`{text}`").rlike(CANONICAL), F.lit(False)).alias("is_canonical"),
    )


def mailbox_settings(corpus_metadata: DataFrame) -> DataFrame:
    """``mailbox, time_zone, date_order`` from the corpus metadata."""
    return corpus_metadata.select(
        F.col("user_email").alias("mailbox"), F.col("extraction_params")["time_zone"].alias("time_zone"), F.col("extraction_params")["date_order"].alias("date_order")
    )


def found_instants(emails: DataFrame, corpus_metadata: DataFrame) -> DataFrame:
    """``pos, utc_micros`` of each row whose date denotes an instant but isn't yet in the canonical form."""
    out = normalise_instants(emails.select("pos", "mailbox", "received_date"), mailbox_settings(corpus_metadata))
    return out.where(~F.col("is_canonical") & F.col("utc_micros").isNotNull()).select("pos", "utc_micros")
