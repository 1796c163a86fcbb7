"""Keyed tables: first per key, merge, delete, and fingerprints of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """The row with the least ``order`` of each key; ``order`` is unique. Rows without key are left out."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return rows.join(least, [key, order], "left_semi")


def merge_by_key(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Insert or replace: the new rows (the last of a key) and the old rows whose key isn't among them."""
    last = new.groupBy(key).agg(F.max(order).alias(order))
    fresh = new.join(last, [key, order], "left_semi")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def only_new(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """The first new row of each key that isn't there yet."""
    return first_per_key(new, key, order).join(existing.select(key).distinct(), key, "left_anti")


def delete_keys(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def union_first(sources: list[DataFrame], key: str = "id", order: str = "pos") -> DataFrame:
    """Sources one after the other; a key is kept where it comes first."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    least = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("source_no", order)).alias("at"))
    return every.join(least.select(key, F.col("at.source_no").alias("source_no"), F.col(f"at.{order}").alias(order)), [key, "source_no", order], "left_semi")


def key_fingerprint(rows: DataFrame, key: str = "id", buckets: int = 4096) -> DataFrame:
    """``n, fingerprint``: a hash of the set of keys that doesn't depend on order.

    The distinct keys of each hash bucket are sorted and hashed, then the bucket hashes; so no task holds all keys.
    """
    part = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k")).distinct()
    part = part.groupBy(F.substring(F.sha2("k", 256), 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "|"), 256).alias("h"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "|"), 256), F.lit("")).alias("fingerprint"))


def id_set_hash(rows: DataFrame, key: str = "id") -> str:
    """SHA-256 of the distinct keys in order, joined by "|"; "" without keys.

    The hash is one chain over all keys, so they stream through the driver range by range and no more than one range is held; ``key_fingerprint``
    compares sets in parallel.
    """
    import hashlib

    ordered = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k")).distinct().orderBy("k")
    h, first = hashlib.sha256(), True
    for r in ordered.toLocalIterator():
        h.update(r.k.encode() if first else b"|" + r.k.encode())
        first = False
    return "" if first else h.hexdigest()
