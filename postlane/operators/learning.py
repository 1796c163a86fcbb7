"""What decisions teach, classifiers behind one interface, and their combination."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlane.operators.reports import category_key


def decision_patterns(decisions: DataFrame, as_of: Column, half_life: float = 90.0, least: float = 3.0, low: float = 0.4) -> DataFrame:
    """``kind, old, new, n, weight, confidence, threshold`` of what reviewers do again and again.

    ``decisions`` has ``action`` (accept, rename, merge, delete), ``old``, ``new``, ``confidence`` and ``decided_at``. A decision weighs half as much after every
    ``half_life`` days; a pattern's weights sum to ``least``. Renames and merges go by (old, new), accepts by name (always_accept), deletions
    of a confidence up to ``low`` are one pattern, whose ``threshold`` is their mean confidence and 0.05. Decisions later than ``as_of`` weigh 1.
    """
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("decided_at")) / 86_400e6)
    kind = F.when(F.col("action").isin("rename", "merge"), F.col("action")).when(F.col("action") == "accept", "always_accept").when((F.col("action") == "delete") & (F.col("confidence") <= low), "delete_low_confidence")
    rows = decisions.withColumns({"kind": kind, "w": F.pow(F.lit(2.0), -days / half_life)}).where("kind is not null and not (kind in ('rename', 'merge') and (old is null or new is null or old = new))")
    old = F.when(F.col("kind") != "delete_low_confidence", F.col("old"))
    g = rows.groupBy("kind", old.alias("old"), F.when(F.col("kind").isin("rename", "merge"), F.col("new")).alias("new")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.avg("confidence").alias("mean"))
    ratio = F.col("weight") / least
    return g.where(F.col("weight") >= least - 1e-6).select(
        "kind", "old", "new", "n", "weight", F.least(0.5 + 0.2 * F.when(ratio > 1, F.log2(ratio)).otherwise(0.0), F.lit(0.99)).alias("confidence"), F.when(F.col("kind") == "delete_low_confidence", F.round(F.col("mean") + 0.05, 2)).alias("threshold")
    )


def decision_scores(decisions: DataFrame) -> DataFrame:
    """``category, score``: +1 for an accept of the name and for a rename to it, -1 for a deletion."""
    name = F.when(F.col("action") == "rename", F.col("new")).otherwise(F.col("old"))
    s = F.when(F.col("action").isin("accept", "rename"), 1.0).when(F.col("action") == "delete", -1.0)
    return decisions.select(category_key(name).alias("category"), s.alias("s")).where("s is not null and category is not null").groupBy("category").agg(F.sum("s").alias("score"))


def learned_actions(suggestions: DataFrame, patterns: DataFrame, least: float = 0.8) -> DataFrame:
    """``name, action, new``: what the surest pattern of ``least`` confidence does to each suggestion; none leaves it for review."""
    p = patterns.where(F.col("confidence") >= least)
    by_name = suggestions.join(p.where("kind in ('always_accept', 'rename')").select(F.col("old").alias("name"), "kind", "new", F.col("confidence").alias("c")), "name")
    low = p.where("kind = 'delete_low_confidence'").agg(F.max("threshold").alias("t"), F.max("confidence").alias("c"))
    by_low = suggestions.crossJoin(F.broadcast(low)).where(F.col("confidence") <= F.col("t")).select("name", F.lit("delete_low_confidence").alias("kind"), F.lit(None).cast("string").alias("new"), "c")
    best = by_name.select("name", "kind", "new", "c").unionByName(by_low).groupBy("name").agg(F.max_by(F.struct("kind", "new"), F.struct("c", "kind")).alias("b"))
    return best.select("name", F.when(F.col("b.kind") == "always_accept", "accept").when(F.col("b.kind") == "rename", "rename").otherwise("delete").alias("action"), "b.new")


def with_classifier(categorised: DataFrame, classified: DataFrame, name: str, least: float = 0.6) -> DataFrame:
    """Rule results, and where no rule matched the classifier's result of at least ``least`` confidence; ``classified`` has one row an id."""
    c = classified.select(F.col("email_id").alias("id"), F.col("category_name").alias("__c"), F.col("confidence").alias("__p"))
    j = categorised.join(c, "id", "left")
    use = (F.col("source") == "none") & (F.col("__p") >= least)
    use = F.coalesce(use, F.lit(False))
    return j.select("id", F.when(use, F.col("__c")).otherwise(F.col("category")).alias("category"), F.when(use, F.col("__p")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, F.lit(f"classifier:{name}")).otherwise(F.col("source")).alias("source"))


def ensemble(classified: DataFrame, order: list[tuple[str, float]]) -> DataFrame:
    """``email_id, category, confidence, source``: the first classifier in ``order`` that reaches its threshold, else the surest one (ties by order).

    ``classified`` has ``email_id, source, category_name, confidence``, one row a mail and source; sources that aren't in ``order`` and null confidences don't count.
    """
    place, threshold = F.lit(None).cast("int"), F.lit(None).cast("double")
    for k, (name, least) in enumerate(order):
        place, threshold = F.when(F.col("source") == name, k).otherwise(place), F.when(F.col("source") == name, least).otherwise(threshold)
    rows = classified.withColumns({"place": place, "least": threshold}).where("place is not null and confidence is not null")
    passed = F.col("confidence") >= F.col("least")
    rank = F.struct(F.when(passed, 0).otherwise(1).alias("a"), F.when(passed, F.col("place").cast("double")).otherwise(-F.col("confidence")).alias("b"), F.col("place").alias("c"))
    best = rows.groupBy("email_id").agg(F.min(F.struct(rank.alias("rank"), "category_name", "confidence", "source")).alias("m"))
    return best.select("email_id", F.col("m.category_name").alias("category"), "m.confidence", F.concat(F.lit("ensemble:"), "m.source").alias("source"))


@dataclasses.dataclass(frozen=True)
class Answer:
    category: str
    confidence: float
    note: str | None = None


def checked(answer: Answer, allowed: list[str]) -> Answer:
    """An answer outside the allowed categories keeps its name but no more than 0.3 confidence, and says so."""
    by = {a.lower(): a for a in allowed}
    if answer.category.lower() in by:
        return dataclasses.replace(answer, category=by[answer.category.lower()], confidence=max(0.0, min(1.0, answer.confidence)))
    return Answer(answer.category, min(0.3, max(0.0, answer.confidence)), "unknown category")


def classify(mails: DataFrame, provider: Callable[[], Callable[[list[str]], list[Answer]]], allowed: list[str], size: int = 64, attempts: int = 3) -> DataFrame:
    """``email_id, category_name, confidence, note`` by a provider of answers, which each task opens once and calls with ``size`` texts.

    A call that fails is tried again up to ``attempts`` times; then its mails come out as "Uncategorized" with the error as note, so no row is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for b in batches:
            out = []
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                for k in range(attempts):
                    try:
                        answers = [checked(a, allowed) for a in ask(list(part["text"]))]
                        break
                    except Exception as x:  # noqa: BLE001 - whatever the provider raises
                        answers = [Answer("Uncategorized", 0.0, str(x)[:200])] * len(part)
                out += [(i, a.category, a.confidence, a.note) for i, a in zip(part["id"], answers)]
            yield pd.DataFrame(out, columns=["email_id", "category_name", "confidence", "note"])

    text = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\nBody: "), F.coalesce("body_text", F.lit("")))
    return mails.select("id", text.alias("text")).mapInPandas(run, "email_id string, category_name string, confidence double, note string")


def hashed_vectors(dim: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A provider of vectors that needs no model: hashed words, of length 1."""

    def open_():
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
            return out

        return embed

    return open_


def embed(rows: DataFrame, text: str, provider: Callable, key: str = "id", size: int = 64) -> DataFrame:
    """``key, embedding`` of the texts, in calls of ``size``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for b in batches:
            vectors = [v for at in range(0, len(b), size) for v in ask(list(b[text].iloc[at : at + size]))]
            yield pd.DataFrame({key: b[key], "embedding": vectors})

    return rows.select(key, text).mapInPandas(run, f"{key} string, embedding array<float>")


def few_shot(training: DataFrame, features: int = 1 << 14, least: int = 8):
    """A logistic model over hashed words, and the categories with under ``least`` examples that it leaves out.

    ``training`` has ``text`` and ``category``. Returns ``(model, skipped)``; ``model.transform`` adds ``predicted`` to rows with ``text``; the model is None if no category has enough.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    sizes = training.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    skipped = [r.category for r in sizes.where(F.col("n") < least).orderBy("category").collect()]  # categories, not examples
    if sizes.where(F.col("n") >= least).isEmpty():
        return None, skipped
    rows = training.join(sizes.where(F.col("n") >= least).select("category"), "category", "left_semi").select("category", F.coalesce("text", F.lit("")).alias("text"))
    labels = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=40, regParam=0.01), IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(labels.transform(rows)), skipped


def emerging_topics(mails: DataFrame, known: DataFrame, cluster: str = "cluster", least: int = 10, ratio: float = 0.5, words: int = 5) -> DataFrame:
    """``cluster, n, n_new, topic, keywords``: clusters mostly made of ids that aren't ``known``, with their most frequent subject words.

    ``topic`` are the first three words and the first label of the most frequent domain, each beginning with a capital.
    """
    from postlane.functions import words as W
    from postlane.operators.suggest import top_per_group

    fresh = mails.join(known.select("id").distinct(), "id", "left_anti")
    n_new = fresh.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_new"))
    hot = mails.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).join(n_new, cluster).where((F.col("n_new") >= least) & (F.col("n_new") / F.col("n") > ratio))
    inside = fresh.join(hot.select(cluster), cluster, "left_semi")
    token = inside.select(cluster, "pos", F.explode(F.split(F.lower("subject"), r"\s+")).alias("w")).where(F.col("w").rlike(r"^\p{L}{3,}$") & ~F.col("w").isin(W.STOP_WORDS))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    best = top_per_group(token, cluster, F.col("w"), words).groupBy(cluster).agg(order("value").alias("keywords"))
    domain = top_per_group(inside, cluster, F.split(F.lower("sender_domain"), r"\.")[0], 1).select(cluster, F.col("value").alias("d"))
    j = hot.join(best, cluster, "left").join(domain, cluster, "left")
    parts = F.concat(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 3), F.when(F.col("d").isNotNull(), F.array("d")).otherwise(F.array().cast("array<string>")))
    return j.select(cluster, "n", "n_new", F.array_join(F.transform(parts, lambda w: W.capitalised(w)), " ").alias("topic"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def ranked(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
