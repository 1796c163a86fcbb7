"""Writers: tables as JSON, CSV and logs by Spark; small reports as text."""

from __future__ import annotations

import html
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("category_id", "category_name", "description", "confidence", "email_count", "percentage", "parent_name")


def category_rows(categories: DataFrame) -> DataFrame:
    """The columns of the CSV export, with the parent's name where it is among the rows."""
    p = categories.select(F.col("category_id").alias("__p"), F.col("category_name").alias("parent_name"))
    return categories.join(p, F.col("parent_category_id") == F.col("__p"), "left").select(*CSV_COLUMNS)


def write_csv(categories: DataFrame, path: str) -> None:
    """With a header and a byte order mark in front of it, as spreadsheets expect."""
    rows = category_rows(categories)
    rows.withColumnRenamed(CSV_COLUMNS[0], "﻿" + CSV_COLUMNS[0]).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_json(rows: DataFrame, path: str) -> None:
    """Whole or not at all: the committer moves the files when every task is done."""
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; mails without category are not logged."""
    kept = rows.where(F.lower("category_name") != "uncategorized") if "category_name" in rows.columns else rows
    kept.write.mode("append").json(path)


def summary(categories: DataFrame) -> DataFrame:
    """One row: categories, mails, mean confidence in whole percent; counts that are null are 0."""
    return categories.agg(F.count(F.lit(1)).alias("categories"), F.sum(F.coalesce("email_count", F.lit(0))).alias("mails"), F.round(F.avg("confidence") * 100).alias("mean_confidence"))


def html_report(categories: DataFrame) -> str:
    """A page with the summary and a row a category, by share; categories number few (a review list), mails don't enter."""
    s = summary(categories).first()
    rows = "".join(
        f"<tr><td>{html.escape(r.category_name or '')}</td><td>{r.email_count if r.email_count is not None else ''}</td><td>{(r.confidence or 0) * 100:.0f}%</td><td>{html.escape(r.source or '')}</td></tr>"
        for r in categories.orderBy(F.col("percentage").desc_nulls_last(), "category_id").toLocalIterator()
    )
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Categories</title></head><body><p>{s.categories} categories, {s.mails} mails, mean confidence {s.mean_confidence or 0:.0f}%</p><table>{rows}</table></body></html>"


def markdown_report(categories: DataFrame) -> str:
    lines = ["| Category | Mails | Share | Confidence |", "| --- | --- | --- | --- |"]
    for r in categories.orderBy(F.col("percentage").desc_nulls_last(), "category_id").toLocalIterator():
        lines.append(f"| {(r.category_name or '').replace('|', '/')} | {r.email_count if r.email_count is not None else ''} | {'' if r.percentage is None else f'{r.percentage:.1f}%'} | {(r.confidence or 0) * 100:.0f}% |")
    return "\n".join(lines) + "\n"


def _conditions(source: str | None, name: str) -> tuple[str, str]:
    """Which field a category's rule looks at, by where the category comes from."""
    return ("from", name) if source == "sender" else ("subject", name)


def outlook_rules(categories: DataFrame) -> str:
    """An XML list of rules: a condition and the folder to move to for every category."""
    out = []
    for r in categories.orderBy("category_id").toLocalIterator():
        field, value = _conditions(r.source, r.category_name or "")
        out.append(f"<rule name={quoteattr(r.category_name or '')}><condition field={quoteattr(field)}>{escape(value)}</condition><move>{escape(r.category_name or '')}</move></rule>")
    return "<?xml version='1.0' encoding='utf-8'?><rules>" + "".join(out) + "</rules>"


def gmail_filters(categories: DataFrame) -> str:
    """An Atom feed of filters that label mails by category."""
    out = []
    for r in categories.orderBy("category_id").toLocalIterator():
        field, value = _conditions(r.source, r.category_name or "")
        props = f"<apps:property name={quoteattr(field)} value={quoteattr(value)}/><apps:property name='label' value={quoteattr(r.category_name or '')}/>"
        out.append(f"<entry><category term='filter'/><title>Mail Filter</title>{props}</entry>")
    return "<?xml version='1.0' encoding='UTF-8'?><feed xmlns='http://www.w3.org/2005/Atom' xmlns:apps='http://schemas.google.com/apps/2006'><title>Mail Filters</title>" + "".join(out) + "</feed>"
