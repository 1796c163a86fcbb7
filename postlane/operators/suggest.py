"""Categories suggested from templates, senders and clusters, and the rules that follow from them."""

from __future__ import annotations

import dataclasses
import difflib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlane.functions import texts as T
from postlane.functions import words as W
from postlane.operators.rules import Condition, Rule


@dataclasses.dataclass(frozen=True)
class Template:
    name: str
    keywords: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()


def top_per_group(rows: DataFrame, group: str, value: Column, n: int = 10, name: str = "value", order: str = "pos") -> DataFrame:
    """``group, name, n, first_pos, rank``: the most frequent values of each group, ties by first appearance. Null values don't count.

    Counts by (group, value) come first, so the ranking meets distinct values only.
    """
    counts = rows.select(group, value.alias(name), order).where(F.col(name).isNotNull()).groupBy(group, name).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_pos"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "first_pos", name)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def domain_in(c: Column, domains: tuple[str, ...]) -> Column:
    """Whether a domain is one of the domains or lies below one; false for null."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | W.domain_matches(F.lower(c), F.lit(d.lower()))
    return F.coalesce(hit, F.lit(False))


def matched_ids(mails: DataFrame, t: Template) -> DataFrame:
    """The distinct ids of mails with a keyword as a word in the subject, or from one of the domains."""
    return mails.where(T.has_keyword(F.col("subject"), list(t.keywords)) | domain_in(F.col("sender_domain"), t.domains)).select("id").distinct()


def match_templates(mails: DataFrame, templates: list[Template], cluster: str = "cluster", samples: int = 5, top: int = 10) -> DataFrame:
    """``template, n, pct, confidence``: the mails of the clusters that a template fits, each mail once.

    A template fits a cluster if one of the cluster's first ``samples`` mails has a keyword in its subject, or one of its ``top`` domains is one
    of the template's; then all mails of the cluster count, and beside them all mails from the template's domains. Each template is a column, so
    the mails are read once for all of them.
    """
    w = Window.partitionBy(cluster).orderBy("pos")
    bucket = Window.partitionBy(cluster, F.pmod("pos", F.lit(64))).orderBy("pos")
    first = mails.withColumn("__b", F.row_number().over(bucket)).where(F.col("__b") <= samples).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= samples)
    domains = top_per_group(mails, cluster, F.lower("sender_domain"), top, "domain")
    by_word = first.groupBy(cluster).agg(*[F.max(T.has_keyword(F.col("subject"), list(t.keywords))).alias(f"k{i}") for i, t in enumerate(templates)])
    by_domain = domains.groupBy(cluster).agg(*[F.max(domain_in(F.col("domain"), t.domains)).alias(f"d{i}") for i, t in enumerate(templates)])
    fits = by_word.join(by_domain, cluster, "left")
    j = mails.select(cluster, "id", "sender_domain").join(fits, cluster)
    no = F.lit(False)
    hits = [F.count_if(F.coalesce(F.col(f"k{i}"), no) | F.coalesce(F.col(f"d{i}"), no) | domain_in(F.col("sender_domain"), t.domains)).alias(f"n{i}") for i, t in enumerate(templates)]
    one = j.agg(F.count(F.lit(1)).alias("total"), *hits)
    named = F.explode(F.array(*[F.struct(F.lit(t.name).alias("template"), F.col(f"n{i}").alias("n")) for i, t in enumerate(templates)])).alias("x")
    pct = F.col("n") * 100.0 / F.col("total")
    return one.select("total", named).select("total", "x.*").where("n > 0").select("template", "n", pct.alias("pct"), F.greatest(F.lit(0.1), F.least(F.lit(0.9), 2 * pct / 100)).alias("confidence"))


def merge_candidates(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs of categories with an overlap of ``least``."""
    return overlaps.where(F.col("jaccard") >= least)


def distinctiveness(categories: DataFrame, overlaps: DataFrame, name: str = "category") -> DataFrame:
    """``category, distinctiveness``: 1 less the mean overlap with all other categories; 1 for a category alone."""
    n = categories.agg((F.count(F.lit(1)) - 1).alias("others"))
    both = overlaps.select(F.col("a").alias(name), "jaccard").unionByName(overlaps.select(F.col("b").alias(name), "jaccard")).groupBy(name).agg(F.sum("jaccard").alias("s"))
    return categories.join(both, name, "left").crossJoin(F.broadcast(n)).select(name, (1 - F.coalesce(F.col("s") / F.nullif(F.col("others"), F.lit(0)), F.lit(0.0))).alias("distinctiveness"))


@dataclasses.dataclass
class Suggestion:
    name: str
    count: int
    confidence: float
    ids: tuple[str, ...] = ()


def merge_similar(found: list[Suggestion]) -> list[Suggestion]:
    """Suggestions, each pair that is about the same merged into the more confident one, in order; a list of suggestions is short.

    About the same: names alike by more than 0.9 and sizes by more than 0.3, or names by 0.8 and example ids by more than 0.7. The merged suggestion keeps
    the count of the one that stays, and the ten smallest ids of both.
    """
    out: list[Suggestion] = []
    for s in found:
        for k, t in enumerate(out):
            alike = difflib.SequenceMatcher(None, s.name.lower(), t.name.lower()).ratio()
            sizes = min(s.count, t.count) / max(s.count, t.count, 1)
            either = set(s.ids) | set(t.ids)
            if alike > 0.9 and sizes > 0.3 or alike >= 0.8 and either and len(set(s.ids) & set(t.ids)) / len(either) > 0.7:
                best = s if s.confidence > t.confidence else t
                out[k] = dataclasses.replace(best, ids=tuple(sorted(either)[:10]))
                break
        else:
            out.append(s)
    return out


def suggest(mails: DataFrame, templates: list[Template], cluster: str = "cluster", least_pct: float = 5.0, senders: int = 20, least_mails: int = 20) -> list[Suggestion]:
    """Suggestions from templates, from clusters of ``least_pct`` percent and from the ``senders`` most frequent senders with ``least_mails`` mails, merged and
    by confidence; no more than templates, 20 clusters and senders there can be."""
    total = max(1, mails.count())
    rows = [Suggestion(r.template, r.n, r.confidence) for r in match_templates(mails, templates, cluster).orderBy("template").collect()]
    sizes = mails.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 100.0 / total >= least_pct)
    rows += [Suggestion(str(r[0]), r.n, min(1.0, r.n / total * 2)) for r in sizes.orderBy(F.col("n").desc(), cluster).collect()]
    by = mails.where("sender_email is not null").groupBy(F.lower("sender_email").alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_mails).orderBy(F.col("n").desc(), "s").limit(senders)
    rows += [Suggestion(r.s, r.n, min(1.0, r.n / total * 2)) for r in by.collect()]
    return sorted(merge_similar(rows), key=lambda s: (-s.confidence, s.name))


def rule_conditions(mails: DataFrame, category: str = "category", keywords: int = 5, domains: int = 3) -> DataFrame:
    """``category, field, operator, value, ord``: for each category its most frequent subject words and sender domains, as conditions of one rule."""
    words = mails.select(category, "pos", F.explode(W.subject_words(F.col("subject"))).alias("w"))
    by_word = top_per_group(words, category, F.col("w"), keywords).select(category, F.lit("subject").alias("field"), F.lit("contains").alias("operator"), "value", F.col("rank").alias("ord"))
    by_domain = top_per_group(mails, category, F.lower("sender_domain"), domains).select(category, F.lit("sender_domain").alias("field"), F.lit("equals").alias("operator"), "value", (F.col("rank") + keywords).alias("ord"))
    return by_word.unionByName(by_domain)


def build_rules(conditions: DataFrame, names: list[str], category: str = "category") -> list[Rule]:
    """One rule a category, any condition enough; a category without conditions looks for its name in the subject. At most 8 conditions a category are read."""
    by: dict[str, list] = {}
    for r in conditions.where(F.col(category).isin(names)).orderBy(category, "ord").collect():
        by.setdefault(r[category], []).append(Condition(r.field, r.operator, r.value))
    return [Rule(f"rule_{n}", n, tuple(by.get(n) or [Condition("subject", "contains", n)]), "or", 50) for n in names]


def condition_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, c.field, c.operator, c.value.lower()) for r in rules for c in r.conditions], "rule_id string, field string, operator string, value string")


def shared_conditions(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rule_a, rule_b, shared``: how many (field, value) conditions two sets of rules have in common."""
    x = a.select(F.col("rule_id").alias("rule_a"), "field", "value").distinct()
    y = b.select(F.col("rule_id").alias("rule_b"), "field", "value").distinct()
    return x.join(y, ["field", "value"]).groupBy("rule_a", "rule_b").agg(F.count(F.lit(1)).alias("shared"))


def cluster_names(mails: DataFrame, cluster: str = "cluster", n: int = 10) -> DataFrame:
    """``cluster, term, score, rank``: the subject words that stand for a cluster, by tf-idf of two texts, the cluster and the whole corpus.

    Every word of a cluster stands in both texts, so its smoothed idf is ``ln(3 / 3) + 1``; scores are the counts over their Euclidean length.
    """
    words = mails.select(cluster, "pos", F.explode(W.subject_words(F.col("subject"))).alias("term"))
    counts = words.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("tf"))
    length = counts.groupBy(cluster).agg(F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("length"))
    w = Window.partitionBy(cluster).orderBy(F.col("tf").desc(), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(length, cluster).select(cluster, "term", (F.col("tf") / F.col("length")).alias("score"), "rank")
