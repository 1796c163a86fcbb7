"""Incremental runs: new mails as a stream, merged, assigned and counted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlane.operators.keyed import first_per_key, only_new


def mail_stream(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files of mails as they arrive; where it stopped is kept in the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def deduplicated(stream: DataFrame, at: str = "ingested_at", late: str = "30 days", key: str = "id") -> DataFrame:
    """The first row of each key; repeats are known for as long as mails may be late, so the state doesn't grow for ever."""
    return stream.where(F.col(key).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, at: str = "ingested_at", late: str = "30 days", by: str | None = None) -> DataFrame:
    """``start, n`` of each day (and ``by``); a day is final once mails can't be late for it."""
    keys = [F.window(at, "1 day").alias("w"), *([by] if by else [])]
    return stream.withWatermark(at, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *([by] if by else []), "n")


def assign_clusters(mails: DataFrame, vectors: DataFrame, centres: DataFrame, key: str = "id") -> DataFrame:
    """``key, assigned, similarity`` of mails with a vector, by the nearest centre."""
    from postlane.operators.vectors import assign_nearest

    return assign_nearest(mails.select(key).join(vectors, key), centres, key=key)


def merge_sizes(sizes: DataFrame, assigned: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, pct``: clusters with the newly assigned mails added, shares rounded to two places."""
    new = assigned.groupBy(F.col("assigned").alias(label)).agg(F.count(F.lit(1)).alias("__new"))
    j = sizes.select(label, "n").join(new, label, "full").select(label, (F.coalesce("n", F.lit(0)) + F.coalesce("__new", F.lit(0))).alias("n"))
    total = j.agg(F.sum("n").alias("__t"))
    return j.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("n") * 100.0 / F.col("__t"), 2).alias("pct"))


def run(stream: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, key: str = "id", order: str = "pos") -> StreamingQuery:
    """Starts a run over all that has arrived and ends it; the store holds each key once, however often a batch is repeated.

    Each batch is cut down to keys that the store doesn't have, written as a folder of its own named after the batch - a batch that is tried
    again overwrites its folder - and given to ``then`` (assign, categorise, report) as the true difference.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{store}/batch={number}"
        there = _stored(spark, store, batch.schema, number)
        fresh = only_new(there, batch, key, order) if there is not None else first_per_key(batch, key, order)
        fresh.write.mode("overwrite").parquet(path)
        if then is not None:
            then(spark.read.schema(batch.schema).parquet(path), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, store: str, schema, before: int) -> DataFrame | None:
    """What batches before this one have written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    kept = spark.read.parquet(store).where(F.col("batch") < before)
    return kept.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
