"""Problem 8: sources mixed to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.tokens import DEFAULT_RANKS, token_counts
from postlane.operators.ranking import running
from postlane.session import cut, stage


def source_key(c: Column) -> Column:
    """A source name in lower case without outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def plan_copies(available: dict[str, int], targets: dict[str, tuple[float, int | None]], total: float | None = None) -> dict[str, float]:
    """Expected copies of each text of a source, so that sizes follow the shares as far as the caps allow.

    Shares are scaled to the sources that have text. Sources at their cap give all they may; what they lack goes
    to the others in proportion to their shares, until nothing changes. ``total`` is the size of the mix, by
    default the size of all texts.
    """
    live = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and available.get(s, 0) > 0 and (r is None or r > 0)}
    total = float(sum(available.values())) if total is None else float(total)
    copies, capped, left = {}, set(), total
    while True:
        open_ = {s: w for s, (w, _) in live.items() if s not in capped}
        weight = sum(open_.values())
        full = {s for s, w in open_.items() if live[s][1] is not None and left * w / weight >= live[s][1] * available[s]}
        if not full:
            for s, w in open_.items():
                copies[s] = left * w / weight / available[s]
            return copies
        for s in full:
            copies[s] = float(live[s][1])
            left -= live[s][1] * available[s]
        capped |= full


def _sized(documents: DataFrame, path: str) -> DataFrame:
    """One row per source and text: its first document and its size. Equal texts of a source count as one text."""
    texts = documents.where("text is not null and text != ''").select(source_key(F.col("source")).alias("source"), "doc_id", "text").where("source is not null")
    first = texts.select("source", "doc_id", F.sha2("text", 256).alias("h")).groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")
    return stage(token_counts(texts.join(first, ["source", "doc_id"], "left_semi"), path).select("source", "doc_id", "n_tokens"), "sized")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, total: float | None = None, path: str = DEFAULT_RANKS) -> DataFrame:
    """``source, doc_id, copy_no, n_tokens``: the mixed set, one row per use of a text.

    Systematic sampling: within its source, in an order drawn by ``seed``, each text's expected copies are summed
    up and one random offset is added; the text is used once per whole number that its own share crosses. So
    every text is used floor or ceil of the expected copies, never more than ``max_repeats`` (null: no limit).
    The running number is taken by ranges, so that a source with most documents is many tasks.

    Sizes are tokens of a public tokenizer. Source names match without case and outer white space; a source
    without target, with share 0, null share or cap 0 gives nothing, as do null and empty texts and texts without
    source. Equal texts of a source are one text. Empty tables give no rows. ``targets`` is one row per source.
    """
    sized = _sized(documents, path)
    spark = documents.sparkSession
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("w"), F.min("max_repeats").alias("r"))
    # one row per source that has a target
    sums = goal.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("a")), "source", "left").collect()
    everything = total if total is not None else (sized.agg(F.sum("n_tokens")).first()[0] or 0)
    copies = plan_copies({r.source: r.a or 0 for r in sums}, {r.source: (r.w or 0.0, r.r) for r in sums}, everything)
    if not copies:
        return sized.where("false").select("source", "doc_id", F.lit(1).alias("copy_no"), "n_tokens")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("offset")
    rates = F.broadcast(spark.createDataFrame(list(copies.items()), "source string, rate double").select("*", offset))
    chosen = sized.join(rates, "source")
    numbered = running(chosen, "source", [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")], name="k")
    # rounded, so that whole rates stay whole
    upto = lambda k: F.floor(F.round(k * F.col("rate"), 6) + F.col("offset"))
    uses = (upto(F.col("k")) - upto(F.col("k") - 1)).cast("int")
    return numbered.withColumn("uses", uses).where("uses > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"), "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 42, total: float | None = None, path: str = DEFAULT_RANKS) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_uses, n_texts, most_uses`` of every source with a target."""
    mixed = cut(mix(documents, targets, seed, total, path))
    per = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("u"), F.sum("n_tokens").alias("t")).groupBy("source").agg(
        F.sum("t").alias("n_tokens"), F.sum("u").alias("n_uses"), F.count(F.lit(1)).alias("n_texts"), F.max("u").alias("most_uses")
    )
    whole = mixed.agg(F.sum("n_tokens").alias("whole"))
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    return goal.join(per, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, zero).alias(c) for c in ("n_tokens", "n_uses", "n_texts", "most_uses")]
    )
