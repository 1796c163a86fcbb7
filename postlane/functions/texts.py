"""Column functions over HTML, MIME parts, header values, addresses and model answers."""

from __future__ import annotations

import base64
import difflib
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


class _Text(HTMLParser):
    """The text outside scripts and styles, piece by piece."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain_text(source: str | None) -> str | None:
    """The visible text of HTML, white space as single blanks; null if there is no source; markup that can't be parsed is cut out by its signs."""
    if source is None:
        return None
    try:
        p = _Text()
        p.feed(source)
        p.close()
        text = " ".join(p.parts)
    except Exception:  # noqa: BLE001 - whatever a broken document raises
        text = html.unescape(re.sub(r"<[^>]*>", " ", source))
    return re.sub(r"\s+", " ", text).strip()


@F.pandas_udf(StringType())
def html_to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``plain_text`` of a column; empty documents give an empty text."""
    for s in batches:
        yield s.map(plain_text, na_action="ignore")


def mime_body(part: dict | None, depth: int = 10) -> str | None:
    """The body of a message part: of its leaves the first in HTML, else the first plain one, else the payload itself."""

    def leaves(p: dict, level: int):
        children = p.get("parts") or []
        if children and level < depth:
            for x in children:
                yield from leaves(x, level + 1)
        elif (data := (p.get("body") or {}).get("data")) is not None:
            yield p.get("mimeType") or "", data

    if not part:
        return None
    found = list(leaves(part, 0))
    best = next((d for t, d in found if t == "text/html"), None) or next((d for t, d in found if t == "text/plain"), None) or next((d for _, d in found), None)
    if best is None:
        return None
    return base64.urlsafe_b64decode(best + "=" * (-len(best) % 4)).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def mime_text(payloads: pd.Series) -> pd.Series:
    """The body text of message parts given as JSON (``mimeType``, ``body.data`` in base64url, ``parts``); unreadable ones are null."""
    import json

    def read(x):
        try:
            body = mime_body(json.loads(x))
        except ValueError:
            return None
        return plain_text(body) if body and "<" in body else body

    return payloads.map(read, na_action="ignore")


def parse_sender(header: Column) -> Column:
    """struct(name, email) of a From header: ``name <address>``, ``"name" <address>`` or an address alone; empty is ``unknown@unknown.com``."""
    h = F.trim(F.coalesce(header, F.lit("")))
    inside = F.trim(F.regexp_extract(h, r"<([^<>]*)>", 1))
    name = F.trim(F.regexp_replace(F.regexp_extract(h, r"^([^<]*)<", 1), '^[\\s"]+|[\\s"]+$', ""))
    alone = F.regexp_extract(h, f"({ADDRESS})", 1)
    email = F.when(inside != "", inside).when(alone != "", alone).otherwise("unknown@unknown.com")
    return F.struct(F.when(name != "", name).otherwise(F.split(email, "@")[0]).alias("name"), F.lower(email).alias("email"))


def is_address(c: Column) -> Column:
    """Whether the text is one address; false for null."""
    return F.coalesce(c.rlike(f"^{ADDRESS}$"), F.lit(False))


def is_clock(c: Column) -> Column:
    """Whether the text is a time of day as HH:MM; false for null."""
    return F.coalesce(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))


def without_fence(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def wrapped(tag: str, c: Column) -> Column:
    """The text as an XML element, with the signs of markup escaped."""
    text = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two names without case; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def keyword_pattern(words: list[str]) -> str:
    """A pattern for whole words in lower-case text, Unicode letters counting as letters."""
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", w.lower()) for w in words)
    return rf"(?U)\b(?:{quoted})\b"


def has_keyword(c: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text as a word; false for null and without words."""
    return F.coalesce(F.lower(c).rlike(keyword_pattern(words)), F.lit(False)) if words else F.lit(False)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c.isNotNull(), "low")


def strength(score: Column) -> Column:
    """struct(probability, label): a score through the logistic curve of slope 5, as strong, moderate or weak."""
    p = 1 / (1 + F.exp(-5 * score))
    return F.struct(p.alias("probability"), F.when(p > 0.7, "strong").when(p >= 0.4, "moderate").when(p.isNotNull(), "weak").alias("label"))


def severity_rank(c: Column) -> Column:
    """0 for the most severe."""
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(4)


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    x = n.cast("double")
    return F.when(x < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(x < 1024**2, F.format_string("%.1f KB", x / 1024)).when(x < 1024**3, F.format_string("%.1f MB", x / 1024**2)).otherwise(F.format_string("%.1f GB", x / 1024**3))


def largest_k(n: int) -> int:
    """How many clusters are tried at most for ``n`` rows."""
    return max(1, min(min(max(int((n / 5) ** 0.5), 3), 25), n - 1))
