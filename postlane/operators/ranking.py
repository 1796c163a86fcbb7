"""Running numbers and sums within keys, where one key may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.session import stage


def running(rows: DataFrame, key: str, order: Sequence[Column], value: Column | None = None, name: str = "turn", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the running sum of ``value`` (a running number from 1, without one) within ``key``.

    The rows are split by ranges of (key, order), so a hot key lies in many ranges; each range is summed by itself
    and gets the sum of the key's ranges before it. Only keys that lie in several ranges need that, at most one a
    range boundary, so the table of these sums is as small as the number of ranges and is broadcast. The order
    has to tell all rows of a key apart, else the result depends on the order of equal rows. Null values count 0.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__o{i}" for i in range(len(order))]
    work = rows.select("*", *[c.alias(x) for c, x in zip(order, names)], F.coalesce(value, F.lit(0)).alias("__v") if value is not None else F.lit(1).cast("long").alias("__v"))
    work = stage(work.repartitionByRange(n, F.col(f"`{key}`"), *names).withColumn("__part", F.spark_partition_id()), "running")
    sums = work.groupBy(F.col(f"`{key}`").alias("__key"), "__part").agg(F.sum("__v").alias("__s"))
    spread = sums.groupBy("__key").agg(F.min("__part").alias("__a"), F.max("__part").alias("__b")).where("__a < __b").select("__key")
    w = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(F.broadcast(spread), "__key", "left_semi").withColumn("__before", F.sum("__s").over(w)).select("__key", F.col("__part").alias("__p2"), "__before")
    inner = Window.partitionBy(F.col(f"`{key}`"), "__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumn("__r", F.sum("__v").over(inner))
    out = out.join(F.broadcast(before), (F.col(f"`{key}`") == F.col("__key")) & (F.col("__part") == F.col("__p2")), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], (F.col("__r") + F.coalesce("__before", F.lit(0))).alias(name))
