"""Problem 4: one entity for the addresses and spellings of a person or an organisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import gazetteers as G
from postlane.operators.graph import connected_components
from postlane.session import cut

_TITLE = re.compile(rf"^(?:(?:{'|'.join(G.TITLES)})\.?\s+)+", re.I)
_LEGAL = re.compile(r"[\s,]+(?:" + "|".join(re.escape(x) for x in sorted(G.LEGAL_FORMS, key=len, reverse=True)) + r")\.?$", re.I)
_TAIL = re.compile(r"\s+via\s.*$|\s*[(\[].*$|\s+[-|–—@/]\s.*$|\s+<.*$", re.I | re.S)
_TRADE = {y: t for t, short in G.TRADES.items() for y in [t, *short.split()]}
_ROLE = set(G.ROLE_MAILBOXES)
_SHORT = G.short_form_table()

#: A given name is a typo of a neighbour that has so many times its partner words; a listed one counts as five times that at least.
TYPO_RATIO = 4

PARSED = "address string, n bigint, kind string, first string, second string, surname_first boolean, initials array<string>, local string, local_head string, label string"


def _parse(address: str, name: str | None) -> tuple:
    """(kind, first, second, surname_first, initials, local, local_head, label) of one spelling."""
    local, _, domain = address.partition("@")
    local = local.split("+")[0]
    labels = [x for x in domain.split(".") if x]
    label = G.fold(labels[-2] if len(labels) > 1 else (labels[0] if labels else ""))
    bare = re.sub(r"[\d._-]+$", "", local)
    text = re.sub(r"\s+", " ", (name or "").strip())
    low = text.lower()
    is_org = local in _ROLE or bare in _ROLE or bool(_LEGAL.search(text)) or low.startswith("the ") or low.endswith(" team")
    if is_org:
        t = re.sub(r"^the\s+|\s+team$", "", _LEGAL.sub("", text), flags=re.I)
        words = [w for w in re.split(r"[\s\-,_/]+", G.fold(t)) if w]
        trade = next((_TRADE[w.rstrip(".")] for w in reversed(words[1:]) if w.rstrip(".") in _TRADE), "")
        return "org", words[0] if words else "", trade, False, [], G.fold(local), "", label
    t = _TITLE.sub("", _TAIL.sub("", text))
    comma = "," in t
    raw = [w for w in re.split(r"[\s,]+", t) if re.search(r"\w", w)]
    full = [w for w in raw if len(w.strip(".")) > 1 and not (w.endswith(".") and len(w) <= 2)]
    initials = [G.fold(w[0]) for w in raw if w not in full]
    folded = [G.fold(w.strip(".'’")) for w in full]
    if len(folded) > 2:
        folded = [folded[0], folded[-1]]
    first, second = (folded + ["", ""])[:2]
    caps = len(full) > 1 and full[0].isupper() and len(full[0]) > 2
    return "person", first, second, comma or caps, initials, re.sub(r"[^a-z]", "", G.fold(re.split(r"\d", local.replace(".priv", ""))[0])), re.split(r"[._\-]", G.fold(re.sub(r"\d.*$", "", local)))[0], label


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(a, n, *_parse(a, x)) for a, x, n in zip(b["address"], b["name"], b["n"])]
        yield pd.DataFrame(rows, columns=["address", "n", "kind", "first", "second", "surname_first", "initials", "local", "local_head", "label"])


def _is_typo(a, b):
    """One letter left out, added, changed or two neighbours swapped."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein(a, b)
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def _cuts(c):
    """A word and the word without each of its letters."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def spellings(emails: DataFrame, least_share: float = 0.6) -> DataFrame:
    """``address, name, n``: the spellings of each sender address.

    An address that never shows a name takes the one that most mails to it use, if that one has at least
    ``least_share`` of them: names beside recipients are often those of somebody else.
    """
    address = F.lower("sender_email")
    own = emails.where(F.col("sender_email").contains("@")).groupBy(address.alias("address"), F.col("sender_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    nameless = own.groupBy("address").agg(F.max(F.coalesce(F.trim("name") != "", F.lit(False))).alias("named")).where("not named").select("address")
    to = emails.where(F.trim("recipient_name") != "").groupBy(F.lower("recipient_email").alias("address"), F.col("recipient_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    most = to.join(nameless, "address", "left_semi").groupBy("address").agg(F.max_by(F.struct("name", "n"), F.struct("n", "name")).alias("m"), F.sum("n").alias("all"))
    given = most.where(F.col("m.n") >= least_share * F.col("all")).select("address", F.col("m.name").alias("name"), F.lit(1).cast("long").alias("n"))
    return own.unionByName(given).groupBy("address", "name").agg(F.sum("n").alias("n"))


def _person_rows(parsed: DataFrame) -> DataFrame:
    """``address, n, surname, given, initial``: the parts of each spelling of a person, by where each word occurs elsewhere."""
    spark = parsed.sparkSession
    rows = parsed.where("kind = 'person'")
    two = rows.where("first != '' and second != ''")
    partners = two.select(F.col("first").alias("word"), F.col("second").alias("with")).unionByName(two.select(F.col("second").alias("word"), F.col("first").alias("with")))
    degree = partners.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("degree"))
    listed = spark.createDataFrame([(k,) for k in _SHORT], "word string").withColumn("listed", F.lit(True))
    degree = degree.join(F.broadcast(listed), "word", "full").select("word", (F.coalesce("degree", F.lit(0)) + F.when(F.col("listed"), 1000).otherwise(0)).alias("degree"))
    degree = cut(degree)
    d = lambda c: degree.select(F.col("word").alias(c), F.col("degree").alias(f"d_{c}"))
    two = two.join(d("first"), "first", "left").join(d("second"), "second", "left").fillna(0, ["d_first", "d_second"])
    in_local = lambda c: (F.length(c) > 3) & F.col("local").contains(F.col(c))
    surname_is_first = (
        F.when((F.col("d_first") >= 1000) & (F.col("d_second") < 1000), False).when((F.col("d_second") >= 1000) & (F.col("d_first") < 1000), True)
        .when(F.col("d_first") >= 3 * F.col("d_second") + 3, False).when(F.col("d_second") >= 3 * F.col("d_first") + 3, True)
        .when(in_local("first") & ~in_local("second"), True).when(in_local("second") & ~in_local("first"), False).otherwise(F.col("surname_first"))
    )
    two = two.withColumn("sf", surname_is_first)
    both = two.select("address", "n", "local", "local_head", F.when(F.col("sf"), F.col("first")).otherwise(F.col("second")).alias("surname"), F.when(F.col("sf"), F.col("second")).otherwise(F.col("first")).alias("given"), F.lit(None).cast("string").alias("initial"))
    one = rows.where("first != '' and second = ''").select("address", "n", "local", "local_head", F.col("first").alias("surname"), F.lit(None).cast("string").alias("given"), F.get("initials", F.lit(0)).alias("initial"))
    none = rows.where("first = ''").select("address", "n", "local", "local_head", F.lit(None).cast("string").alias("surname"), F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("initial"))
    out = both.unionByName(one).unionByName(none)
    # a given name that is rare against its best known neighbour is read as a typo of it; listed names are always known
    raw = (F.col("degree") - F.when(F.col("listed"), 1000).otherwise(0)).alias("raw")
    degree = degree.join(F.broadcast(listed), "word", "left").select("word", "degree", raw, F.coalesce("listed", F.lit(False)).alias("listed"))
    known = degree.where("listed or raw >= 5").select(F.col("word").alias("right"), F.col("degree").alias("rd"), F.when(F.col("listed"), F.greatest("raw", F.lit(TYPO_RATIO * 5))).otherwise(F.col("raw")).alias("often"))
    rare = out.where("given is not null").select("given").distinct().join(degree.where("not listed").select(F.col("word").alias("given"), F.col("raw").alias("seldom")), "given")
    near = (
        rare.withColumn("k", F.explode(_cuts(F.col("given")))).join(known.withColumn("k", F.explode(_cuts(F.col("right")))), "k")
        .where((F.col("given") != F.col("right")) & (F.col("often") >= TYPO_RATIO * F.col("seldom"))).where(_is_typo(F.col("given"), F.col("right"))).groupBy("given").agg(F.max_by("right", F.struct("rd", "right")).alias("fixed"))
    )
    return out.join(near, "given", "left").withColumn("given", F.coalesce("fixed", "given")).drop("fixed")


def entities(emails: DataFrame) -> DataFrame:
    """``entity, address, kind``: every sender address with ``@`` (lower-cased) and the entity it belongs to.

    Merge and rematch. Each address starts as an entity whose profile is the union of its spellings: surnames,
    given names (short forms stand for one or several full names), initials and what its mailbox name says. A
    round blocks entities by (surname, given name) and merges those that share a block; a profile without a full
    given name joins the only full name that fits its surname and initial or short form. The merged profiles -
    now with more spellings - enter the next round, until no entity merges. A surname that no mailbox name
    confirms may also merge over one typo. Organisations are blocked by name and trade, read from the domain and
    the spellings; they never merge with persons.

    Blocks are merged as stars on the block, never as pairs. An address without any usable word is an entity of its
    own. Null and empty names carry no evidence, repeated rows add weight only, an empty table gives no rows.
    """
    spark = emails.sparkSession
    parsed = cut(spellings(emails).mapInPandas(_parse_batches, PARSED))
    kinds = parsed.groupBy("address").agg(F.max(F.col("kind") == "org").alias("org"))
    parsed = parsed.join(kinds.where("org"), "address", "left_anti").unionByName(parsed.where("kind = 'org'"))
    people = cut(_person_rows(parsed))

    # evidence rows: address, surname, given candidates, weight
    shorts = spark.createDataFrame([(k, list(v)) for k, v in _SHORT.items()], "word string, fulls array<string>")
    names = people.join(F.broadcast(shorts), people.given == shorts.word, "left").withColumn("fulls", F.when(F.col("given").isNotNull(), F.coalesce("fulls", F.array("given")))).drop("word")
    # what is left of the mailbox name without the surname is a given name, a short form or an initial
    rest = F.regexp_replace(F.col("local"), F.col("surname"), "")
    local_rows = (
        names.where("surname is not null").select("address", "surname", "initial", "n", "local_head", F.when(F.col("local").contains(F.col("surname")), rest).otherwise(F.col("local")).alias("rest"))
        .join(F.broadcast(shorts.withColumnRenamed("fulls", "local_fulls")), F.col("rest") == F.col("word"), "left").drop("word")
    )
    evidence = names.where("surname is not null").select("address", "surname", "fulls", "initial", F.col("local").contains(F.col("surname")).alias("confirmed"), F.col("n").cast("double").alias("w"))
    extra = local_rows.where("local_fulls is not null").select("address", "surname", F.col("local_fulls").alias("fulls"), "initial", F.lit(False).alias("confirmed"), F.lit(0.5).alias("w")).distinct()
    initial_rows = local_rows.where("length(rest) = 1").select("address", "surname", F.lit(None).cast("array<string>").alias("fulls"), F.col("rest").alias("initial"), F.lit(False).alias("confirmed"), F.lit(0.1).alias("w")).distinct()
    evidence = evidence.unionByName(extra).unionByName(initial_rows)
    # addresses without any name: their mailbox name alone, where it is given name and surname
    pieces = people.groupBy("address").agg(F.max("surname").alias("s"), F.max("local_head").alias("head")).where("s is null").withColumn("p", F.split(F.regexp_replace(F.regexp_replace(F.split("address", "[+@]")[0], r"\d+$", ""), r"\.priv$", ""), "[._-]")).where("size(p) = 2")
    pieces = pieces.select("address", F.explode(F.array(F.struct(F.get("p", F.lit(0)).alias("g"), F.get("p", F.lit(1)).alias("s2")), F.struct(F.get("p", F.lit(1)).alias("g"), F.get("p", F.lit(0)).alias("s2")))).alias("x")).select("address", "x.g", "x.s2")
    bare = pieces.join(F.broadcast(shorts), F.col("g") == F.col("word")).select("address", F.col("s2").alias("surname"), "fulls", F.lit(None).cast("string").alias("initial"), F.lit(True).alias("confirmed"), F.lit(1.0).alias("w"))
    only_initial = pieces.where("length(g) = 1 and length(s2) > 3").select("address", F.col("s2").alias("surname"), F.lit(None).cast("array<string>").alias("fulls"), F.col("g").alias("initial"), F.lit(True).alias("confirmed"), F.lit(1.0).alias("w"))
    evidence = cut(evidence.unionByName(bare).unionByName(only_initial).withColumn("surname", F.regexp_replace("surname", r"([aou])e", "$1")))

    entity = cut(kinds.where("not org").select("address", F.col("address").alias("entity")))
    before = entity.select("entity").distinct().count()
    while True:  # each round but the last leaves fewer entities
        rows = evidence.join(entity, "address")
        votes = rows.where("fulls is not null").select("entity", F.explode("fulls").alias("full"), "w", F.size("fulls").alias("k")).groupBy("entity", "full").agg(F.sum("w").alias("w"), F.min("k").alias("k"))
        top = votes.groupBy("entity").agg(F.max("w").alias("top"))
        fulls = votes.join(top, "entity").where("w >= top").groupBy("entity").agg(F.array_sort(F.collect_set("full")).alias("fulls"))  # bounded by the short-form table and ties
        names_of = rows.groupBy("entity", "surname").agg(F.max("confirmed").alias("confirmed"), F.sum("w").alias("w"), F.array_sort(F.collect_set("initial")).alias("initials"))  # letters
        profile = cut(names_of.join(fulls, "entity", "left"))
        sure = profile.where("size(fulls) = 1").withColumn("full", F.get("fulls", F.lit(0)))
        # block: surname and full given name
        exact = sure.select(F.col("entity").alias("a"), F.concat(F.lit("#"), "surname", F.lit("|"), "full").alias("b"))
        # a typo of a surname: stars on the best confirmed spelling among those that share a cut
        spelled = sure.groupBy("surname", "full").agg(F.max("confirmed").alias("confirmed"), F.sum("w").alias("w")).where("length(surname) >= 5")
        keyed = spelled.withColumn("cut", F.explode(_cuts(F.col("surname"))))
        best = keyed.groupBy("cut", "full").agg(F.max_by("surname", F.struct("confirmed", "w", "surname")).alias("to"))
        typo = keyed.where("not confirmed").join(best, ["cut", "full"]).where("surname != to").where(_is_typo(F.col("surname"), F.col("to"))).select(F.concat(F.lit("#"), "surname", F.lit("|"), "full").alias("a"), F.concat(F.lit("#"), "to", F.lit("|"), "full").alias("b"))
        # no full given name: the only full name of the surname that fits one of the short form's names, or one of the initials
        known = sure.select("surname", "full").distinct()
        by_initial = known.groupBy("surname", F.substring("full", 1, 1).alias("initial")).agg(F.min("full").alias("least"), F.max("full").alias("most"))
        loose = profile.where("fulls is null or size(fulls) > 1").select("entity", "surname", "fulls", "initials")
        by_short = loose.where("size(fulls) > 1").select("entity", "surname", F.explode("fulls").alias("full")).join(known, ["surname", "full"]).select("entity", "surname", F.col("full").alias("least"), F.col("full").alias("most"))
        by_letter = loose.where("fulls is null").select("entity", "surname", F.explode("initials").alias("initial")).join(by_initial, ["surname", "initial"]).select("entity", "surname", "least", "most")
        fit = by_short.unionByName(by_letter).groupBy("entity", "surname").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        joined = fit.where("least = most").select(F.col("entity").alias("a"), F.concat(F.lit("#"), "surname", F.lit("|"), "least").alias("b"))
        alone = loose.join(fit.select("entity", "surname"), ["entity", "surname"], "left_anti").where("size(initials) > 0 or fulls is not null").select(
            F.col("entity").alias("a"), F.concat(F.lit("#"), "surname", F.lit("|?"), F.coalesce(F.array_join("fulls", ","), F.array_join("initials", ""))).alias("b")
        )
        comp = connected_components(exact.unionByName(typo).unionByName(joined).unionByName(alone))
        named = comp.where("node not like '#%'").select(F.col("node").alias("entity"), "component")
        least = named.groupBy("component").agg(F.min("entity").alias("to"))
        entity = cut(entity.join(named.join(least, "component").select("entity", "to"), "entity", "left").select("address", F.coalesce("to", "entity").alias("entity")))
        now = entity.select("entity").distinct().count()
        if now == before:
            break
        before = now

    # organisations: name and trade, from the domain where it tells them, else from the spellings
    org = parsed.where("kind = 'org'")
    label = F.regexp_replace(F.regexp_replace("label", r"-group$", ""), r"-", "")
    trades = sorted(_TRADE, key=len, reverse=True)
    trade_end = F.regexp_extract(label, f"^(.{{3,}}?)({'|'.join(t for t in trades if len(t) > 3)})$", 2)
    stem = F.when(trade_end != "", F.regexp_extract(label, f"^(.{{3,}}?)({'|'.join(t for t in trades if len(t) > 3)})$", 1)).otherwise(label)
    canon = F.create_map(*[x for k, v in _TRADE.items() for x in (F.lit(k), F.lit(v))])
    org = org.withColumn("stem", stem).withColumn("domain_trade", F.when(trade_end != "", F.try_element_at(canon, trade_end)))
    per = org.groupBy("address", "stem", "domain_trade").agg(F.max_by("second", F.when(F.col("second") != "", F.col("n")).otherwise(0)).alias("named_trade"))
    per = per.withColumn("trade", F.coalesce("domain_trade", F.when(F.col("named_trade") != "", F.col("named_trade"))))
    only = per.where("trade is not null").groupBy("stem").agg(F.min("trade").alias("t0"), F.max("trade").alias("t1")).where("t0 = t1")
    per = per.join(only, "stem", "left").withColumn("trade", F.coalesce("trade", "t0", F.lit("")))
    org_entity = per.select("address", F.concat(F.lit("org:"), "stem", F.lit("|"), "trade").alias("entity"), F.lit("organisation").alias("kind"))
    return org_entity.select("entity", "address", "kind").unionByName(entity.select("entity", "address", F.lit("person").alias("kind")))


#: An entity is split into parts of about so many addresses, so that a large organisation's pairs are made by many tasks.
PART = 500


def found_pairs(emails: DataFrame) -> DataFrame:
    """``email_a, email_b``: each pair of different addresses of one entity, the smaller first.

    Pairs grow with the square of an entity; ``entities`` is the same result as membership. The first addresses of an entity are
    spread over its parts, and the second ones are copied to each.
    """
    e = cut(entities(emails).select("entity", "address").distinct())
    sizes = e.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity", (F.floor(F.col("n") / PART) + 1).alias("parts"))
    sized = e.join(sizes, "entity")
    a = sized.select("entity", F.col("address").alias("email_a"), F.pmod(F.xxhash64("address"), F.col("parts")).alias("part"))
    b = sized.select("entity", F.col("address").alias("email_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["entity", "part"]).where("email_a < email_b").select("email_a", "email_b")
