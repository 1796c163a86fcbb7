"""Problem 1: conversations from single messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.operators.graph import connected_components, forest_roots
from postlane.operators.instants import mailbox_settings, normalise_instants
from postlane.operators.ranking import running
from postlane.session import cut, stage

# What exporters write for "no value".
NONE_WORDS = ["", "null", "none", "nil", "undefined", "n/a", "na", "nan", "-", "0", "unknown"]
VISIBLE = r"[^\s\p{Z}\p{C}]"

#: Weights of the evidence for a link. A header outweighs all other evidence together; among the names of one header, and within
#: a thread, time, mention and words decide.
W_REPLY, W_LAST_REFERENCE, W_REFERENCE, W_THREAD = 8.0, 6.0, 4.0, 2.0
W_TIME, W_MENTION, W_WORDS = 0.6, 0.6, 0.6


def real_value(c: Column) -> Column:
    """The trimmed value, or null where it only stands for "none" (also a run of zeros)."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(NONE_WORDS) & ~t.rlike(r"^[0\-]*$"), t)


def names_in(c: Column) -> Column:
    """The message names in a header field, in order, in whatever notation: JSON, JSON within JSON, cut off, plain, with <>."""
    tokens = F.regexp_extract_all(c, F.lit(r"[^\s\"'<>\[\]{},;\\]+"), F.lit(0))
    return F.coalesce(F.filter(tokens, lambda t: ~F.lower(t).isin(NONE_WORDS)), F.array())


def _words(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"^\s*((re|aw|fw|fwd|wg|sv|odp|rv|tr)\s*:\s*)+", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def messages(emails: DataFrame, corpus_metadata: DataFrame) -> DataFrame:
    """One row per ``id`` (the first delivered; rows without id are left out) with what linking needs; ``pos`` is its key."""
    narrow = emails.where(F.col("id").isNotNull()).select(
        "pos", "id", "mailbox", "received_date", F.lower("sender_email").alias("sender"), F.lower(F.trim("recipient_email")).alias("recipient"), "subject",
        F.coalesce(F.col("body_text").rlike(VISIBLE), F.lit(False)).alias("has_text"), real_value(F.col("thread_id")).alias("thread"),
        names_in(F.col("in_reply_to")).alias("reply"), names_in(F.col("references_json")).alias("refs"), F.get(names_in(F.col("provider_message_id")), F.lit(0)).alias("message_id"),
    )
    dated = normalise_instants(narrow, mailbox_settings(corpus_metadata)).drop("received_date", "mailbox", "is_canonical", "zone_status")
    return dated.groupBy("id").agg(F.min_by(F.struct(*[c for c in dated.columns if c != "id"]), "pos").alias("m")).select("id", "m.*")


def named_mails(mails: DataFrame) -> DataFrame:
    """``pos, names_missing, answers, named`` of each mail whose headers name any.

    ``named`` are the mails named that exist, as ``(w, parent)``: the weight of the header and the ``pos`` of the mail;
    ``names_missing`` tells whether one doesn't exist; ``answers`` is the mail answered: in_reply_to, without it the
    last reference. A name is an id or a provider message id.
    """
    names = mails.select(F.col("id").alias("name"), "pos").unionByName(mails.where("message_id is not null").select(F.col("message_id").alias("name"), "pos"))
    names = names.groupBy("name").agg(F.min("pos").alias("parent"))
    n_reply, n_refs = F.size("reply"), F.size("refs")
    given = mails.where((n_reply > 0) | (n_refs > 0)).select("pos", n_reply.alias("n_reply"), n_refs.alias("n_refs"), F.posexplode(F.concat("reply", "refs")).alias("place", "name"))
    is_reply, is_last = F.col("place") < F.col("n_reply"), F.col("place") == F.col("n_reply") + F.col("n_refs") - 1
    weight = F.when(is_reply, W_REPLY).when(is_last, W_LAST_REFERENCE).otherwise(W_REFERENCE)
    answers = (F.col("place") == 0) & is_reply | (F.col("n_reply") == 0) & is_last
    found = given.select("pos", "name", weight.alias("w"), answers.alias("is_answer")).join(names, "name", "left")
    there = F.col("parent").isNotNull() & (F.col("parent") != F.col("pos"))
    return found.groupBy("pos").agg(
        F.max(F.col("parent").isNull()).alias("names_missing"), F.min(F.when(F.col("is_answer"), F.col("parent"))).alias("answers"),
        F.collect_set(F.when(there, F.struct("w", "parent"))).alias("named"),  # no more than a mail's own headers hold
    )


def thread_candidates(mails: DataFrame, linked: DataFrame) -> DataFrame:
    """``pos, parent``: the earlier mails of its thread that may be the likeliest parent of each mail not in ``linked``.

    The score falls with time and else depends on mention and shared subject words, so the candidates of a mail are the
    latest earlier mail of its thread, the latest from its recipient and the latest to its sender; in threads with several
    subjects also these three with its own subject, and the latest mail with each word of its subject. Keys grow with
    the words of a subject, not with the mails or subjects of the thread. Each is an as-of join: the running
    number of the candidates of a key, by ranges, so that a hot thread is many tasks. Mails of one instant follow ``pos``.
    """
    words = _words(F.col("subject"))
    pool = mails.where("thread is not null").select("pos", "thread", "sender", "recipient", F.coalesce("utc_micros", F.lit(0)).alias("utc_micros"), words.alias("words"), F.hash(F.sort_array(words)).alias("topic"))
    # threads of several mails of which one at least asks, with whether they have several subjects
    marked = pool.join(linked.withColumn("has_link", F.lit(True)), "pos", "left")
    threads = marked.groupBy("thread").agg(F.count(F.lit(1)).alias("size"), (F.min("topic") != F.max("topic")).alias("several"), F.max(F.col("has_link").isNull()).alias("asks")).where("size > 1 and asks").select("thread", "several")
    rows = marked.join(threads, "thread")

    def keys(from_: str, to: str):
        def part(kind, *who):
            text = F.concat("thread", F.lit(f"\n{kind}\n"), *who)
            return F.when(text.isNotNull(), F.xxhash64(text))

        topic = F.col("topic").cast("string")
        plain = [part("any"), part("from", from_), part("to", to)]
        more = [part("any of", topic), part("from of", topic, F.lit(" "), from_), part("to of", topic, F.lit(" "), to)]
        return F.concat(F.array(*plain), F.when(F.col("several"), F.concat(F.array(*more), F.transform("words", lambda w: part("word", w)))).otherwise(F.array()))

    def keyed(df: DataFrame, role: int, from_: str, to: str) -> DataFrame:
        return df.select(F.explode(keys(from_, to)).alias("key"), "utc_micros", "pos", F.lit(role).cast("byte").alias("role")).where("key is not null")

    both = keyed(rows.where("has_link is null"), 0, "recipient", "sender").unionByName(keyed(rows, 1, "sender", "recipient"))
    numbered = stage(running(both, "key", [F.col("utc_micros"), F.col("pos"), F.col("role")], value=F.col("role"), name="n"), "thread-order")
    asked = numbered.where("role = 0 and n > 0").select("key", "n", "pos")
    return asked.join(numbered.where("role = 1").select("key", "n", F.col("pos").alias("parent")), ["key", "n"]).select("pos", "parent").distinct()


def reply_links(mails: DataFrame, named: DataFrame, weights: tuple[float, float, float] = (W_TIME, W_MENTION, W_WORDS)) -> DataFrame:
    """``pos, parent, score``: the likeliest parent of each mail that has a candidate.

    Candidates are the mails that its headers name and, for a mail that names none which exists (a name outweighs
    them all), those of ``thread_candidates``. A link is scored by the header that names it, how close the two are in time,
    whether the mail is addressed to the candidate's sender, or came from whom the candidate was addressed to, and the words their subjects share
    (``weights``). Of the names of one mail only those of the heaviest header are scored, as no other evidence makes up for a
    header. A parent is earlier than its mail, in time or at the same instant by ``pos``, so the links are a forest.
    Ties go to the larger instant, then the smaller ``pos``.
    """
    time, mention, shared = weights
    heaviest = F.array_max("named")["w"]
    by_name = named.where(F.size("named") > 0).select("pos", F.explode(F.filter("named", lambda x: x["w"] == heaviest)).alias("x")).select("pos", "x.parent", "x.w")
    by_thread = thread_candidates(mails, by_name.select("pos").distinct()).withColumn("w", F.lit(W_THREAD))
    # two independent hashes of a thread stand for it, so that a candidate of another thread can't slip in
    thread = F.when(F.col("thread").isNotNull(), F.xxhash64(F.lit(1), "thread"))
    address = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    about = mails.select("pos", address("sender"), address("recipient"), F.coalesce("utc_micros", F.lit(0)).alias("utc"), F.transform(_words(F.col("subject")), lambda x: F.hash(x)).alias("words"), thread.alias("thread"))
    parent = about.select(F.col("pos").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in about.columns if c != "pos"])
    pairs = by_name.unionByName(by_thread).join(about, "pos").join(parent, "parent")
    pairs = pairs.where((F.struct("p_utc", "parent") < F.struct("utc", "pos")) & ((F.col("w") > W_THREAD) | F.col("thread").eqNullSafe(F.col("p_thread"))))
    days = (F.col("utc") - F.col("p_utc")) / 86_400e6
    union = F.size(F.array_union("words", "p_words"))
    score = (
        F.col("w") + time / (1 + days)
        + mention * F.coalesce(((F.col("recipient") == F.col("p_sender")) | (F.col("sender") == F.col("p_recipient"))).cast("double"), F.lit(0.0))
        + shared * F.coalesce(F.when(union > 0, F.size(F.array_intersect("words", "p_words")) / union), F.lit(0.0))
    )
    best = pairs.select("pos", F.struct(score.alias("score"), "p_utc", (-F.col("parent")).alias("p")).alias("link")).groupBy("pos").agg(F.max("link").alias("b"))
    return best.select("pos", (-F.col("b.p")).alias("parent"), F.col("b.score").alias("score"))


def link_trees(mails: DataFrame, links: DataFrame, named: DataFrame) -> DataFrame:
    """``pos, tree, comp``: the tree of each mail in the forest of its links, and the conversation.

    The trees come from the likeliest parents alone. A mail has one parent but may name several others, and threads hold
    mails that answer nobody; so trees are completed to conversations by the names that were not chosen and by shared
    threads, which join whole trees. ``tree`` and ``comp`` are the ``pos`` of one of their mails.
    """
    roots = forest_roots(links.select(F.col("pos").alias("node"), F.col("parent").alias("up")))
    trees = stage(mails.select("pos", "thread").join(roots.withColumnRenamed("node", "pos"), "pos", "left").select("pos", "thread", F.coalesce("root", "pos").alias("tree")), "trees")
    others = named.select("pos", F.explode("named.parent").alias("parent")).distinct().join(links.select("pos", "parent"), ["pos", "parent"], "left_anti")
    at = trees.select("pos", "tree")
    by_name = others.join(at.withColumnRenamed("tree", "a"), "pos").join(at.select(F.col("pos").alias("parent"), F.col("tree").alias("b")), "parent").select("a", "b")
    in_thread = trees.where("thread is not null").select("thread", "tree").distinct()
    first = in_thread.groupBy("thread").agg(F.min("tree").alias("b"), F.max("tree").alias("last")).where("b < last").select("thread", "b")
    by_thread = in_thread.join(first, "thread").select(F.col("tree").alias("a"), "b")
    comp = connected_components(by_name.unionByName(by_thread).where("a != b"))
    return at.join(comp, F.col("tree") == F.col("node"), "left").select("pos", "tree", F.coalesce("component", "tree").alias("comp"))


def conversations(emails: DataFrame, corpus_metadata: DataFrame) -> DataFrame:
    """``conv_id, turn, role, email_id, parent_id, link_score, utc_micros`` of each mail of each conversation kept.

    Each mail hangs on its likeliest parent (``reply_links``; null for a mail without candidate); the links form trees, and
    trees that a further name or a shared real thread id ties together are one conversation (``link_trees``). A
    conversation is kept if
    it has two mails and two senders at least, every mail named in it exists, every date is readable, every body
    has a visible character and no mail is dated before the one its headers say it answers. ``turn`` follows the
    instants, ties by id; the sender of turn 1 is the ``user``, everybody else the ``assistant``.

    Repeated deliveries count once, rows without id are left out, empty tables give no rows. All steps go by ``pos``.
    """
    mails = stage(messages(emails, corpus_metadata), "messages")
    named = stage(named_mails(mails), "named")
    links = stage(reply_links(mails, named), "links")
    placed = link_trees(mails, links, named)
    instants = mails.select(F.col("pos").alias("answers"), F.col("utc_micros").alias("answered_at"))
    answered = named.select("pos", "names_missing", "answers").join(instants, "answers", "left").drop("answers")
    full = mails.select("pos", "id", "sender", "utc_micros", "has_text").join(placed, "pos").join(answered, "pos", "left")
    full = stage(full.select(
        "pos", "id", "comp", "sender", "utc_micros",
        (F.coalesce("names_missing", F.lit(False)) | ~F.col("has_text") | F.col("utc_micros").isNull() | F.coalesce(F.col("utc_micros") < F.col("answered_at"), F.lit(False))).alias("bad"),
    ), "placed")
    kept = full.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), F.min("sender").alias("s0"), F.max("sender").alias("s1"), F.max("bad").alias("bad"), F.min(F.struct("utc_micros", "id", "sender")).alias("opener")
    ).where("n >= 2 and s0 != s1 and not bad").select("comp", F.col("opener.id").alias("conv_id"), F.col("opener.sender").alias("opened_by"))
    rows = full.join(kept, "comp").select("conv_id", "pos", F.col("id").alias("email_id"), (F.col("sender") == F.col("opened_by")).alias("is_opener"), "utc_micros")
    turns = running(rows, "conv_id", [F.col("utc_micros"), F.col("email_id")], name="turn")
    parent_of = links.join(mails.select(F.col("pos").alias("parent"), F.col("id").alias("parent_id")), "parent").select("pos", "parent_id", F.col("score").alias("link_score"))
    return turns.join(parent_of, "pos", "left").select("conv_id", "turn", F.when(F.col("is_opener"), "user").otherwise("assistant").alias("role"), "email_id", "parent_id", "link_score", "utc_micros")


def conversation_texts(emails: DataFrame, corpus_metadata: DataFrame) -> DataFrame:
    """The kept turns with their subject and whole text."""
    first = emails.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("pos").alias("pos"))
    turns = conversations(emails, corpus_metadata).join(first, F.col("email_id") == F.col("id")).drop("id")
    text = emails.select("pos", "subject", F.col("body_text").alias("text"))
    return turns.join(text, "pos").select("conv_id", "turn", "role", "email_id", "parent_id", "subject", "text")
