"""Rules over mails: compiled into columns, one scan for all of them."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.functions import words as W

FIELDS = ("sender_email", "sender_domain", "sender_name", "recipient_email", "subject", "body_text", "has_attachments")


@dataclasses.dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str
    case_sensitive: bool = False


@dataclasses.dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    conditions: tuple[Condition, ...]
    logic: str = "and"
    priority: int = 0
    enabled: bool = True
    category_id: str | None = None


def field_value(name: str) -> Column:
    """A field as text; attachments as "true" or "false"."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name}")
    return F.when(F.col("has_attachments"), "true").otherwise("false") if name == "has_attachments" else F.col(name)


def compile_condition(spark: SparkSession, c: Condition) -> Column:
    """A predicate that is never null: a null field fails all operators but the two negative ones, which it passes.

    A pattern that doesn't compile never matches.
    """
    raw = field_value(c.field)
    v = raw if c.case_sensitive else F.lower(raw)
    x = c.value if c.case_sensitive else c.value.lower()
    op = c.operator
    if op == "matches_regex":
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(c.value)
        except Exception:  # noqa: BLE001 - PatternSyntaxException comes wrapped
            return F.lit(False)
        return F.coalesce(raw.rlike(("(?U)" if c.case_sensitive else "(?iU)") + c.value), F.lit(False))
    if op == "in_list":
        return F.coalesce(v.isin([p.strip() for p in x.split(",")]), F.lit(False))
    positive = {"contains": v.contains(x), "equals": v == x, "starts_with": v.startswith(x), "ends_with": v.endswith(x)}
    if op in positive:
        return F.coalesce(positive[op], F.lit(False))
    if op == "not_contains":
        return F.coalesce(~v.contains(x), F.lit(True))
    if op == "not_equals":
        return F.coalesce(v != x, F.lit(True))
    raise ValueError(f"unknown operator {op}")


def compile_rule(spark: SparkSession, r: Rule) -> Column:
    if not r.enabled or not r.conditions:
        return F.lit(False)
    parts = [compile_condition(spark, c) for c in r.conditions]
    return reduce((lambda a, b: a & b) if r.logic == "and" else (lambda a, b: a | b), parts)


def evaluate(mails: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``matched``: the rules that match, by priority (highest first), then in the order given.

    Disabled rules are left out before the plan is made; all others are predicates of one projection.
    """
    spark = mails.sparkSession
    live = [(i, r) for i, r in enumerate(rules) if r.enabled]
    live.sort(key=lambda x: (-x[1].priority, x[0]))
    cells = [
        F.when(compile_rule(spark, r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.priority).alias("priority"), F.lit(len(r.conditions)).alias("conditions"), F.lit(r.category_id).cast("string").alias("category_id"), F.lit(i).alias("ord")))
        for i, r in live
    ]
    empty = "array<struct<rule_id:string,category:string,priority:int,conditions:int,category_id:string,ord:int>>"
    return mails.withColumn("matched", F.array_compact(F.array(*cells)) if cells else F.array().cast(empty))


def categorise(mails: DataFrame, rules: list[Rule]) -> DataFrame:
    """``id, category, confidence, source, secondary, matched_rules``: the first match and the other categories in order."""
    e = evaluate(mails, rules)
    first = F.get("matched", F.lit(0))
    others = F.array_except(F.array_distinct(F.transform("matched", lambda m: m["category"])), F.array(first["category"]))
    hit = F.size("matched") > 0
    return e.select(
        "id", F.when(hit, first["category"]).otherwise("Uncategorized").alias("category"), F.when(hit, W.priority_confidence(first["priority"])).otherwise(0.0).alias("confidence"),
        F.when(hit, F.concat(F.lit("rule:"), first["rule_id"])).otherwise("none").alias("source"), F.when(hit, others).otherwise(F.array().cast("array<string>")).alias("secondary"), F.transform("matched", lambda m: m["rule_id"]).alias("matched_rules"),
    )


def resolve(mails: DataFrame, rules: list[Rule], chain: tuple[str, ...] = ("priority",), history: DataFrame | None = None) -> DataFrame:
    """``id, rule_id, category, confidence, alternatives`` of mails with a match, by the strategies in turn.

    Each strategy ranks; equals go on to the next, then to the order of matching. ``history`` (``category, score``)
    serves the strategy "historical"; it has one row per category.
    """
    e = evaluate(mails, rules).where(F.size("matched") > 0).select("id", F.posexplode("matched").alias("at", "m")).select("id", "at", "m.*")
    if history is not None:
        e = e.join(history.select("category", F.col("score").alias("h")), "category", "left")
    rank = {"priority": -F.col("priority").cast("double"), "specificity": -F.col("conditions").cast("double"), "historical": -F.coalesce(F.col("h") if history is not None else F.lit(0.0), F.lit(0.0)).cast("double")}
    order = F.struct(*[rank[s].alias(f"k{i}") for i, s in enumerate(chain)], F.col("at").cast("double").alias("at"))
    best = e.groupBy("id").agg(F.min_by(F.struct("rule_id", "category", "conditions"), order).alias("w"), F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("category").alias("c")))).alias("l"))
    others = F.array_except(F.array_distinct(F.transform("l", lambda x: x["c"])), F.array(F.col("w.category")))
    return best.select("id", "w.rule_id", "w.category", W.condition_confidence(F.col("w.conditions")).alias("confidence"), others.alias("alternatives"))


def rule_report(mails: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_id, n, pct, examples`` of every rule, disabled ones with 0; examples are the first five ids by position."""
    spark = mails.sparkSession
    hits = evaluate(mails, rules).select("id", "pos", F.explode("matched.rule_id").alias("rule_id"))
    few = hits.groupBy("rule_id", F.pmod("pos", F.lit(256)).alias("b")).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "id"))), 1, 5).alias("l"))
    examples = few.groupBy("rule_id").agg(F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 5), lambda x: x["id"]).alias("examples"))
    n = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    total = mails.agg(F.count(F.lit(1)).alias("total"))
    every = spark.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
    return every.join(n, "rule_id", "left").join(examples, "rule_id", "left").crossJoin(F.broadcast(total)).select(
        "rule_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") * 100.0 / F.col("total"), F.lit(0.0)).alias("pct"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples")
    )


def rule_coverage(mails: DataFrame, rules: list[Rule]) -> DataFrame:
    e = evaluate(mails, rules)
    categories = F.size(F.array_distinct(F.filter(F.transform("matched", lambda m: m["category_id"]), lambda c: c.isNotNull())))
    return e.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("matched") > 0).alias("covered"), F.count_if(F.size("matched") == 0).alias("uncovered"),
        F.count_if((F.size("matched") > 1) & (categories > 1)).alias("conflicts"),
    )


def rule_confusion(mails: DataFrame, rules: list[Rule]) -> DataFrame:
    """How many mails each ordered pair of enabled rules matches together, zeros included; rows only for two rules or more."""
    spark = mails.sparkSession
    live = [r.rule_id for r in rules if r.enabled]
    sets = evaluate(mails, rules).where(F.size("matched") > 1).groupBy(F.transform("matched", lambda m: m["rule_id"]).alias("ids")).agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", F.explode("ids").alias("a"), "ids").select("n", "a", F.explode("ids").alias("b")).where("a != b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    grid = spark.createDataFrame([(a, b) for a in live for b in live if a != b] if len(live) > 1 else [], "a string, b string")
    return grid.join(pairs, ["a", "b"], "left").select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"), F.coalesce("n", F.lit(0)).alias("n"))
