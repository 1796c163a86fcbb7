"""Reports over classifications, corrections, actions and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.functions import words as W


def category_key(c: Column) -> Column:
    """A category name in lower case, with white space and signs as single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))


def latest_per_mail(classifications: DataFrame) -> DataFrame:
    """The last classification of each mail, ties by id."""
    return classifications.where("email_id is not null").groupBy("email_id").agg(F.max_by(F.struct("category_name", "confidence", "source", "model_version", "classified_at", "id"), F.struct("classified_at", "id")).alias("c")).select("email_id", "c.*")


def per_category(latest: DataFrame) -> DataFrame:
    """``category, n, pct``."""
    total = latest.agg(F.count(F.lit(1)).alias("total"))
    return latest.groupBy(category_key(F.col("category_name")).alias("category")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def distribution(values: DataFrame, column: str = "n") -> DataFrame:
    """Mean, median, population deviation and range of a column, zeros without rows."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return values.agg(z(F.avg(column)).alias("mean"), z(F.median(column)).alias("median"), z(F.stddev_pop(column)).alias("std"), z(F.min(column)).alias("min"), z(F.max(column)).alias("max"))


def uncategorised(mails: DataFrame, latest: DataFrame) -> DataFrame:
    named = latest.where(category_key(F.col("category_name")) != "uncategorized").select(F.col("email_id").alias("id"))
    return mails.join(named, "id", "left_anti")


def patterns(mails: DataFrame, least: int = 2) -> DataFrame:
    """``kind, value, n, examples``: domains, addresses and subject prefixes that occur at least ``least`` times.

    One scan: each mail gives its three values; the first five ids are found by buckets, so that a value with most
    mails is many tasks.
    """
    three = F.array(F.struct(F.lit("domain").alias("kind"), F.lower("sender_domain").alias("value")), F.struct(F.lit("sender").alias("kind"), F.lower("sender_email").alias("value")), F.struct(F.lit("subject_prefix").alias("kind"), W.subject_prefix(F.col("subject")).alias("value")))
    rows = mails.select("id", "pos", F.explode(three).alias("x")).select("id", "pos", "x.*").where("value is not null and value != ''")
    few = rows.groupBy("kind", "value", F.pmod("pos", F.lit(256)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "id"))), 1, 5).alias("l"))
    return few.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 5), lambda x: x["id"]).alias("examples")).where(F.col("n") >= least)


def recommendations(found: DataFrame, total: DataFrame, high: float = 0.3, medium: float = 0.1) -> DataFrame:
    """``kind, value, n, share, priority`` of patterns; ``total`` is one row with ``total``."""
    share = F.col("n") / F.col("total")
    return found.crossJoin(F.broadcast(total)).select("kind", "value", "n", share.alias("share"), F.when(share >= high, "high").when(share >= medium, "medium").otherwise("low").alias("priority"))


def accuracy(classifications: DataFrame, corrections: DataFrame) -> DataFrame:
    """``category, classified, corrected, correction_rate``: a full outer join of both counts; without classifications the rate is 1."""
    a = classifications.groupBy(category_key(F.col("category_name")).alias("category")).agg(F.count(F.lit(1)).alias("classified"))
    b = corrections.groupBy(category_key(F.col("old_category")).alias("category")).agg(F.count(F.lit(1)).alias("corrected"))
    j = a.join(b, "category", "full").select("category", F.coalesce("classified", F.lit(0)).alias("classified"), F.coalesce("corrected", F.lit(0)).alias("corrected"))
    rate = F.when(F.col("classified") == 0, F.when(F.col("corrected") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.col("corrected") / F.col("classified")))
    return j.withColumn("correction_rate", rate)


def needs_retraining(rates: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row: whether any rate passes the threshold, and the worst category (ties by name)."""
    return rates.agg(
        F.coalesce(F.max(F.col("correction_rate") > threshold) & (F.sum("classified") > 0), F.lit(False)).alias("needs_retraining"),
        F.max_by("category", F.struct("correction_rate", F.transform(F.split(F.col("category"), ""), lambda c: -F.ascii(c)))).alias("worst"),
    )


def correction_stats(corrections: DataFrame) -> DataFrame:
    return corrections.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("email_id").alias("mails")).withColumn("distinct_rate", F.col("mails") / F.col("total"))


def correction_pairs(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy(category_key(F.col("old_category")).alias("old"), category_key(F.col("new_category")).alias("new")).agg(F.count(F.lit(1)).alias("n"))


def decayed(corrections: DataFrame, as_of: Column, rate: float = 0.01, least: float = 0.1) -> DataFrame:
    """Corrections with their weight of today, those below ``least`` left out."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("corrected_at")) / 86_400e6)
    return corrections.withColumn("decayed_weight", F.col("weight") * F.exp(-rate * days)).where(F.col("decayed_weight") >= least)


def rename_patterns(corrections: DataFrame, as_of: Column, half_life: float = 90.0, least: float = 3.0) -> DataFrame:
    """``old, new, n, weight, confidence`` of changes whose decayed count reaches ``least``."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("corrected_at")) / 86_400e6)
    g = corrections.withColumn("w", F.pow(F.lit(2.0), -days / half_life)).groupBy(category_key(F.col("old_category")).alias("old"), category_key(F.col("new_category")).alias("new")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))
    ratio = F.col("weight") / least
    return g.where((F.col("weight") >= least - 1e-6) & (F.col("old") != F.col("new"))).withColumn("confidence", F.least(0.5 + 0.2 * F.when(ratio > 1, F.log2(ratio)).otherwise(0.0), F.lit(0.99)))


def historical_scores(corrections: DataFrame) -> DataFrame:
    """``category, score``: +1 for each change to a category, -1 for each away from it."""
    two = F.array(F.struct(category_key(F.col("new_category")).alias("category"), F.lit(1.0).alias("s")), F.struct(category_key(F.col("old_category")).alias("category"), F.lit(-1.0).alias("s")))
    return corrections.select(F.explode(two).alias("x")).groupBy("x.category").agg(F.sum("x.s").alias("score"))


def uncertain(latest: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` least certain categorised mails."""
    return latest.where(category_key(F.col("category_name")) != "uncategorized").select("email_id", "category_name", "confidence").orderBy("confidence", "email_id").limit(max(0, n))


def disagreements(classifications: DataFrame, a: str, b: str) -> DataFrame:
    """Mails that two sources put into different categories, by the difference of their confidence."""
    side = lambda s, p: latest_per_mail(classifications.where(F.col("source") == s)).select("email_id", category_key(F.col("category_name")).alias(f"{p}_category"), F.col("confidence").alias(f"{p}_confidence"))
    j = side(a, "a").join(side(b, "b"), "email_id").where("a_category != b_category")
    return j.withColumn("gap", F.abs(F.col("a_confidence") - F.col("b_confidence")))


def source_usage(classifications: DataFrame) -> DataFrame:
    total = classifications.agg(F.count(F.lit(1)).alias("total"))
    return classifications.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence")).crossJoin(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("total")).alias("hit_rate"), "mean_confidence")


def drift(old: DataFrame, new: DataFrame, old_domains: DataFrame, new_domains: DataFrame) -> DataFrame:
    """One row: 0.8 of the change in cluster shares and 0.2 of the change in domain shares.

    Clusters have ``cluster, pct`` (0 to 100), domains ``domain, fraction``.
    """
    c = old.select("cluster", F.col("pct").alias("a")).join(new.select("cluster", F.col("pct").alias("b")), "cluster", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.lit(0.0)).alias("c"))
    d = old_domains.select("domain", F.col("fraction").alias("a")).join(new_domains.select("domain", F.col("fraction").alias("b")), "domain", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.lit(0.0)).alias("d"))
    return c.crossJoin(d).select((F.least(F.col("c") / 200, F.lit(1.0)) * 0.8 + F.col("d") / 2 * 0.2).alias("drift"), F.col("c").alias("cluster_change"), F.col("d").alias("domain_change"))


def cluster_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    j = old.select("cluster", F.col("pct").alias("a")).join(new.select("cluster", F.col("pct").alias("b")), "cluster", "full")
    return j.select("cluster", F.coalesce("a", F.lit(0.0)).alias("old_pct"), F.coalesce("b", F.lit(0.0)).alias("new_pct"), (F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) / 100).alias("change"))


def emerging(new: DataFrame, old: DataFrame, least: int = 10, ratio: float = 0.5) -> DataFrame:
    """Clusters with at least ``least`` ids that weren't there before, more than ``ratio`` of theirs; rows are ``cluster, id``."""
    fresh = new.join(old.select("id").distinct(), "id", "left_anti").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_new"))
    every = new.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return every.join(fresh, "cluster").where((F.col("n_new") >= least) & (F.col("n_new") / F.col("n") > ratio))


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if("reversible").alias("reversible"))


def rollback_candidates(actions: DataFrame) -> DataFrame:
    """Reversible, successful actions on a target that no later action of type rollback names, newest first; with their reverse."""
    undone = actions.where("action_type = 'rollback' and target_id is not null").groupBy("target_id").agg(F.max("action_time").alias("undone_at"))
    to = F.get_json_object("details_json", "$.to")
    reverse = F.when(F.col("action_type") == "move", F.lit("move")).when(F.col("action_type") == "archive", F.lit("unarchive")).when(F.col("action_type") == "mark_read", F.lit("mark_unread")).otherwise(F.concat(F.lit("undo_"), "action_type"))
    return actions.where("reversible and success and action_type != 'rollback' and target_id is not null").join(undone, "target_id", "left").where("undone_at is null or undone_at < action_time").select("id", "action_time", "action_type", "target_id", to.alias("from_folder"), reverse.alias("reverse_type"))


def overlaps(members: DataFrame) -> DataFrame:
    """``a, b, both, either, jaccard`` of each pair of categories that share a mail; rows are ``category, id``.

    Mails with the same set of categories are one row first, so pairs are made of sets of categories, not of mails.
    """
    m = members.distinct()
    sizes = m.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    sets = m.groupBy("id").agg(F.array_sort(F.collect_list("category")).alias("cs")).where("size(cs) > 1").groupBy("cs").agg(F.count(F.lit(1)).alias("c"))
    pairs = sets.select("c", "cs", F.explode("cs").alias("a")).select("c", "a", F.explode("cs").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("c").alias("both"))
    na, nb = sizes.select(F.col("category").alias("a"), F.col("n").alias("na")), sizes.select(F.col("category").alias("b"), F.col("n").alias("nb"))
    either = F.col("na") + F.col("nb") - F.col("both")
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "both", either.alias("either"), (F.col("both") / either).alias("jaccard"))


def training_set(mails: DataFrame, corrections: DataFrame, least: int = 8) -> DataFrame:
    """``email_id, text, category``: the last correction of each mail that exists, for categories with ``least`` examples."""
    last = corrections.groupBy("email_id").agg(F.max_by("new_category", F.struct("corrected_at", "id")).alias("category"))
    rows = last.join(mails.select(F.col("id").alias("email_id"), F.concat_ws(" ", "subject", "body_text").alias("text")), "email_id")
    keep = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("category")
    return rows.join(keep, "category", "left_semi").select("email_id", "text", "category")


def category_confidence(categories: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``category_id, confidence``, from volume, source, share and name; missing counts are 0, features unknown."""
    w = weights or {"cohesion": 0.15, "volume": 0.20, "source": 0.25, "percentage": 0.15, "name": 0.10, "distinct": 0.15}
    volume = F.least(F.lit(1.0), F.log10(F.coalesce("email_count", F.lit(0)) + 1.0) / F.log10(F.lit(101.0)))
    source = F.when(F.col("source") == "template", 0.9).when(F.col("source") == "content_cluster", 0.8).when(F.col("source") == "sender", 0.7).otherwise(0.5)
    share = F.least(F.lit(1.0), F.coalesce("percentage", F.lit(0.0)) / 10)
    name = W.name_quality(F.col("category_name"))["total"]
    total = w["volume"] * volume + w["source"] * source + w["percentage"] * share + w["name"] * name + w["distinct"] * 1.0
    return categories.select("category_id", "category_name", ((volume + source + share) / 3).alias("plain_confidence"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("confidence"), name.alias("name_quality"))


def with_parents(categories: DataFrame) -> DataFrame:
    """Categories with the name of their parent."""
    p = categories.select(F.col("category_id").alias("pid"), F.col("category_name").alias("parent_name"))
    return categories.join(p, F.col("parent_category_id") == F.col("pid"), "left").drop("pid")


def filter_categories(categories: DataFrame, text: str) -> DataFrame:
    """The filter language of a review table: ``source:x``, ``confidence:>N`` or ``confidence:<N`` in percent, else a part of
    name or description; a parent stays if one of its children matches."""
    import re

    t = text.strip().lower()
    if m := re.match(r"source:(\S+)", t):
        hit = F.lower("source").contains(m.group(1))
    elif m := re.match(r"confidence:([<>])(\d+(?:\.\d+)?)", t):
        hit = F.col("confidence") > float(m.group(2)) / 100 if m.group(1) == ">" else F.col("confidence") < float(m.group(2)) / 100
    else:
        hit = F.lower("category_name").contains(t) | F.lower("description").contains(t)
    direct = categories.where(hit)
    parents = direct.where("parent_category_id is not null").select(F.col("parent_category_id").alias("category_id"))
    return categories.join(direct.select("category_id").union(parents).distinct(), "category_id", "left_semi")


def sort_categories(categories: DataFrame, by: str = "email_count", descending: bool = True) -> DataFrame:
    """By name without case, or by a column with nulls last in either direction; ties by id."""
    c = F.lower("category_name") if by == "name" else F.col(by)
    return categories.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "category_id")


def ensure_folders(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``name, status``: trimmed names, blanks dropped, the first of equals without case; "exists" or "create"."""
    w = wanted.select("ord", F.trim("name").alias("name")).where("name != ''").groupBy(F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("name"))
    e = existing.select(F.lower(F.trim("name")).alias("k"), F.trim("name").alias("there")).groupBy("k").agg(F.min("there").alias("there"))
    return w.join(e, "k", "left").select(F.coalesce("there", "name").alias("name"), F.when(F.col("there").isNotNull(), "exists").otherwise("create").alias("status"))


def tfidf_terms(texts: DataFrame, group: str, tokens: Column, n: int = 10) -> DataFrame:
    """``group, term, score, rank``: terms by the smoothed tf-idf of a group against all texts (two documents), normalised."""
    t = texts.select(group, F.explode(tokens).alias("term"))
    own = t.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log(F.lit(3.0) / 3.0) + 1  # each term of a group stands in both documents
    scored = own.withColumn("raw", F.col("tf") * idf)
    norm = scored.groupBy(group).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    w = Window.partitionBy(group).orderBy(F.col("tf").desc(), "term")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(norm, group).select(group, "term", (F.col("raw") / F.col("norm")).alias("score"), "rank")
