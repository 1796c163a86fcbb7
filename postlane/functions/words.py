"""Fixed word lists and column functions over subjects, domains and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that tell the kind of a sender.
SERVICE_KEYWORDS = ["noreply", "no-reply", "donotreply", "notification", "notify", "alert"]
MARKETING_KEYWORDS = ["unsubscribe", "promotional", "offer", "discount", "sale", "promotion"]
WORK_KEYWORDS = ["meeting", "project", "team", "re:", "fwd:"]
# English words that say nothing about a subject.
STOP_WORDS = (
    "a all am an and are as at be been being both but by can could dare did do does each every few for from had has have he here how i if in is it its "
    "just may me might more most must my need no nor not now of on only or other ought our out own same shall she should so some such than that the their "
    "them then there these they this those to too up us used very was we were what when where which who whom whose why will with would you your "
    "best dear email emails fw fwd hello hi mail message messages once please pm re received regards sent sincerely subject thank thanks also"
).split()
# Words of category names: without meaning, of actions, of well-known firms.
GENERIC_WORDS = "category emails general items kind mail messages miscellaneous other related stuff things type various".split()
ACTION_WORDS = (
    "alert alerts confirmation confirmations daily delivered delivery invoice invoiced monthly newsletter notification notifications order ordered paid payment "
    "receipt reminder reminders report reports request requests shipped shipping summary update updates weekly"
).split()
PROPER_NOUNS = (
    "amazon american apple box capital chase citi constant contact costco discover dropbox ebay etsy express facebook fargo github google hubspot linkedin lyft "
    "mailchimp mastercard microsoft netflix paypal salesforce sendgrid shopify slack spotify square stripe target twilio twitter uber venmo visa walmart wells zoom"
).split()
# Labels between a name and a country in a domain.
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu"]
# Subject prefixes that are told apart by case.
SUBJECT_PREFIXES = ["RE:", "Re:", "FWD:", "Fwd:", "FW:", "Fw:"]
# Marks of prompts in mail text, in the order they are taken out.
PROMPT_MARKS = [
    ("SYSTEM:", r"(?im)^\s*system\s*:"), ("ASSISTANT:", r"(?im)^\s*assistant\s*:"), ("USER:", r"(?im)^\s*user\s*:"), ("Human:", r"(?im)^\s*human\s*:"),
    ("[INST]", r"(?i)\[/?INST\]"), ("<<SYS>>", r"(?i)<</?SYS>>"), ("</s>", r"(?i)</s>"), ("code_fence", r"```"),
]


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def normal_subject(c: Column) -> Column:
    """The subject without its reply prefixes, in lower case, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^((re|fwd|fw)\s*:\s*)+", ""), r"\s+", " ")))


def subject_prefix(c: Column) -> Column:
    """``[...]`` at the start, else one of the usual prefixes, else null."""
    t = F.trim(c)
    bracket = F.regexp_extract(t, r"^(\[[^\]]*\])", 1)
    out = F.when(bracket != "", bracket)
    for p in SUBJECT_PREFIXES:
        out = out.when(t.startswith(p), p)
    return out


def subject_words(c: Column) -> Column:
    """Words of a subject without prefixes, tags and numbers: lower-case ASCII words of two letters at least."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)^re:\s*", ""), r"(?i)^fwd:\s*", "")
    t = F.regexp_replace(t, r"[\[\(][^\]\)]+[\]\)]", "")
    t = F.regexp_replace(t, r"[\p{L}\p{N}_]+\s*[#№]\s*\d+", "")
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin(STOP_WORDS))


def numbered_patterns(c: Column) -> Column:
    """The words before ``#`` and a number."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)\s*[#№]\s*\d+"), F.lit(1))


def bracket_tags(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"[\[\(]([^\]\)]+)[\]\)]"), F.lit(1)), F.trim)


def capitalised(c: Column) -> Column:
    """First letter in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))


def domain_of(address: Column) -> Column:
    """What stands between the first and the second ``@``, else "unknown"."""
    return F.coalesce(F.get(F.split(address, "@"), F.lit(1)), F.lit("unknown"))


def strip_domain_suffix(domain: Column) -> Column:
    """A domain without its public ending."""
    p = F.split(F.lower(domain), r"\.")
    n = F.size(p)
    keep = F.when((n >= 3) & F.get(p, n - 2).isin(SECOND_LEVEL), n - 2).when(n >= 2, n - 1).otherwise(n)
    return F.array_join(F.slice(p, F.lit(1), keep), ".")


def domain_matches(domain: Column, other: Column) -> Column:
    return (domain == other) | domain.endswith(F.concat(F.lit("."), other))


def priority_confidence(p: Column) -> Column:
    return F.when(p <= 0, F.lit(0.1)).otherwise(0.1 + F.least(p / 100.0, F.lit(1.0)) * 0.9)


def condition_confidence(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(0.5 + 0.25 * F.log(n + 1.0), F.lit(1.0)))


def slug(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def address_slug(address: Column) -> Column:
    return F.replace(F.replace(address, F.lit("@"), F.lit("_at_")), F.lit("."), F.lit("_"))


def clean_prompt(text: Column) -> tuple[Column, Column]:
    """The text without marks of prompts, and the names of the marks it had; each is looked for in what the ones before left."""
    found = []
    for name, pattern in PROMPT_MARKS:
        found.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, "")
    return text, F.array_compact(F.array(*found))


def name_quality(name: Column) -> Column:
    """struct(total, length_penalty, generic_penalty, caps_penalty, specificity_bonus, proper_bonus, action_bonus)."""
    t = F.trim(name)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    n = F.size(words)
    count = lambda cond: F.size(F.filter(low, cond))
    length = F.when(n < 2, -0.2).when(n > 4, F.greatest(F.lit(-0.3), -0.1 * (n - 4))).otherwise(0.0)
    generic = -0.2 * count(lambda w: w.isin(GENERIC_WORDS))
    caps = F.when((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 1), -0.2).otherwise(0.0)
    specific = F.least(F.lit(0.15), 0.05 * count(lambda w: (F.length(w) > 5) & ~w.isin(GENERIC_WORDS) & ~w.isin(STOP_WORDS)))
    known = count(lambda w: w.isin(PROPER_NOUNS))
    upper = F.size(F.filter(F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1))))
    proper = F.when(known > 0, F.least(F.lit(0.2), 0.1 * known)).otherwise(F.least(F.lit(0.1), 0.05 * upper))
    action = F.least(F.lit(0.15), 0.05 * count(lambda w: w.isin(ACTION_WORDS)))
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + length + generic + caps + specific + proper + action))
    blank = F.coalesce(t, F.lit("")) == ""
    parts = {"total": total, "length_penalty": length, "generic_penalty": generic, "caps_penalty": caps, "specificity_bonus": specific, "proper_bonus": proper, "action_bonus": action}
    return F.struct(*[F.when(blank, F.lit(0.0)).otherwise(v.cast("double")).alias(k) for k, v in parts.items()])
