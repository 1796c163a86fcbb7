"""Problem 3: exact per-key results while a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.session import cut

#: Bins of a refinement round, and the number of keys up to which the table of their intervals is broadcast (8 bytes a fraction
#: and under 200 bytes beside).
BINS, BROADCAST_ROWS = 1024, 100_000


def domain_key(c: Column) -> Column:
    """A domain lower-cased, without outer white space and a final dot."""
    outer = r"[\s\p{Z}\x{FEFF}]+"
    return F.regexp_replace(F.lower(F.regexp_replace(c, rf"^{outer}|{outer}$", "")), r"\.$", "")


def _join_spans(values: DataFrame, spans: DataFrame, salts: int) -> DataFrame:
    """The values beside the one row of spans of their key. Many keys: salted on both sides, so that no key is one task."""
    if spans.count() <= BROADCAST_ROWS:
        return values.join(F.broadcast(spans), F.col("__k") == F.col("__sk"))
    salted = values.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(salts)).cast("int"))
    copies = spans.withColumn("__ssalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, (F.col("__k") == F.col("__sk")) & (F.col("__salt") == F.col("__ssalt")))


def key_quantiles(
    rows: DataFrame, key: Column, value: Column, fractions: Sequence[float] = (0.5, 0.9), bins: int = BINS, salts: int = 32
) -> DataFrame:
    """``key, n, n_values, fraction, quantile, ties``: exact lower quantiles of an integer ``value`` for every key.

    Distributed exact selection. Each (key, fraction) has an interval of values that holds its rank. A round
    counts the rows of each of ``bins`` bins of the interval - a histogram, whose partial counts merge before the
    shuffle, so a key that holds a third of all rows sends ``bins`` numbers a task like any other - and keeps the
    bin with the rank; it ends when every interval is a single value: log(range) / log(bins) rounds, 2 for
    lengths and 5 for microseconds. No value of a key is ever gathered. All intervals of a key have the same width in a round,
    so the interval of a value follows by division and a row is joined to one row of its key, whatever the number of fractions.

    ``quantile`` is the value at rank ``ceil(fraction * n_values)`` (1 at least). ``n`` counts all rows of the key,
    ``n_values`` those whose value isn't null; a key without values has a null quantile. ``ties`` are the key's rows with just that value,
    the count of the last bin. The null key is a key. Repeated rows count; ties have the same value, so they need no rule. An
    empty table gives no rows. The values of a key may lie 2^63 - 1 apart.
    """
    values = rows.select(key.alias("__k0"), value.cast("long").alias("__v"))
    # the null key is carried as a tagged string, for equality joins
    values = values.select(F.when(F.col("__k0").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("__k0").cast("string"))).alias("__k"), "__v")
    totals = cut(values.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.count("__v").alias("n_values"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    asked = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    state = totals.where("n_values > 0").select(F.col("__k").alias("__sk"), asked, "n_values", "lo", "hi")
    rank = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("n_values"))).alias("rank")
    state = state.select("__sk", "fraction", rank, F.col("lo").alias("lo0"), "lo", (F.col("hi") - F.col("lo") + 1).alias("w0"), F.col("n_values").alias("ties"))
    done: list[DataFrame] = []
    present = values.where(F.col("__v").isNotNull())
    level = 0
    while True:
        done.append(state.where(f"w{level} = 1").select("__sk", "fraction", "lo", "ties"))
        state = state.where(f"w{level} > 1")
        if state.isEmpty():
            break
        widths = [f"w{i}" for i in range(1, level + 2)]
        open_ = state.withColumn(widths[-1], F.expr(f"(w{level} - 1) div {bins} + 1"))
        # a key's intervals: as many as fractions at most
        spans = open_.groupBy("__sk").agg(F.first("lo0").alias("lo0"), *[F.first(w).alias(w) for w in widths], F.collect_set("lo").alias("los"))
        within = "(__v - lo0)"
        for w in widths[:-1]:
            within = f"({within} % {w})"
        histogram = (
            _join_spans(present, spans, salts)
            .select("__sk", F.expr(f"__v - {within}").alias("lo"), F.expr(f"{within} div {widths[-1]}").alias("bin"), "los")
            .where(F.array_contains("los", F.col("lo")))
            .groupBy("__sk", "lo", "bin")
            .agg(F.count(F.lit(1)).alias("c"))
        )
        # at most `bins` rows of an interval meet here
        packed = histogram.groupBy("__sk", "lo").agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("bars"))
        picked = open_.join(packed, ["__sk", "lo"]).withColumn(
            "at",
            F.expr(
                """aggregate(bars, named_struct('before', 0L, 'bin', -1L, 'below', 0L, 'c', 0L), (s, b) ->
                     if(s.bin >= 0, s, if(s.before + b.c >= rank, named_struct('before', s.before, 'bin', b.bin, 'below', s.before, 'c', b.c),
                        named_struct('before', s.before + b.c, 'bin', -1L, 'below', 0L, 'c', 0L))))"""
            ),
        )
        lo = (F.col("lo") + F.col("at.bin") * F.col(widths[-1])).alias("lo")
        state = cut(picked.select("__sk", "fraction", (F.col("rank") - F.col("at.below")).alias("rank"), "lo0", lo, *widths, F.col("at.c").alias("ties")))
        level += 1
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    every = totals.select("__k", "n", "n_values", asked)
    found = found.select(F.col("__sk").alias("__k"), "fraction", F.col("lo").alias("quantile"), "ties")
    out = every.join(found, ["__k", "fraction"], "left")
    return out.select(F.when(F.col("__k") != "0", F.substring("__k", 2, 1 << 30)).alias("key"), "n", "n_values", "fraction", "quantile", "ties")


def domain_report(emails: DataFrame) -> DataFrame:
    """Per sender domain: mails, distinct ids, senders, first and latest arrival and the quantiles of body length.

    Distinct counts go by (domain, value) first, so the rows of a hot domain are spread by value; the second step
    adds numbers only.
    """
    key = domain_key(F.col("sender_domain"))
    base = emails.select(key.alias("k"), F.lower("sender_email").alias("s"), "id", "ingested_at", F.length("body_text").alias("len"))
    plain = base.groupBy("k").agg(F.count(F.lit(1)).alias("mails"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("latest_at"))
    senders = base.where("s is not null").groupBy("k", "s").agg(F.lit(1).alias("x")).groupBy("k").agg(F.count(F.lit(1)).alias("senders"))
    ids = base.where("id is not null").groupBy("k", "id").agg(F.lit(1).alias("x")).groupBy("k").agg(F.count(F.lit(1)).alias("distinct_mails"))
    q = key_quantiles(base, F.col("k"), F.col("len"), (0.5, 0.9))
    lengths = q.groupBy("key").agg(
        F.max(F.when(F.col("fraction") == 0.5, F.col("quantile"))).alias("median_chars"), F.max(F.when(F.col("fraction") == 0.9, F.col("quantile"))).alias("p90_chars")
    )
    senders = senders.withColumnRenamed("k", "k1")
    ids = ids.withColumnRenamed("k", "k2")
    return (
        plain.join(senders, F.col("k").eqNullSafe(F.col("k1")), "left")
        .join(ids, F.col("k").eqNullSafe(F.col("k2")), "left")
        .join(lengths, F.col("k").eqNullSafe(F.col("key")), "left")
        .select(F.col("k").alias("sender_domain"), "mails", F.coalesce("distinct_mails", F.lit(0)).alias("distinct_mails"), F.coalesce("senders", F.lit(0)).alias("senders"), "first_at", "latest_at", "median_chars", "p90_chars")
    )


#: Domains are ordered by a hash of so many bits for the selection: 3 rounds of 1024 bins.
HASH_BITS = 30


def found_hot_domains(emails: DataFrame, share: float = 0.04) -> DataFrame:
    """``sender_domain``: the domains that hold at least ``share`` of all rows.

    The whole table is one key of the selection and a domain's hash its value. A domain with ``share`` of the rows covers at
    least one of the ranks that lie ``share / 2`` apart, so it is among the selected values, and the count of its last bin
    (``ties``) is the number of its rows: both come from merged histograms of at most ``2 / share`` intervals. The names of
    the selected hashes are read in a last pass, which also counts by name, in case two domains share a hash.

    Null domains are rows without a value. An empty table, or one without a hot domain, gives no rows.
    """
    domain = emails.select(domain_key(F.col("sender_domain")).alias("sender_domain"))
    rows = domain.withColumn("hash", F.pmod(F.xxhash64("sender_domain"), F.lit(1 << HASH_BITS)))
    value = F.when(F.col("sender_domain").isNotNull(), F.col("hash"))
    ranks = int(2 / share) + 1
    q = cut(key_quantiles(rows, F.lit("all"), value, [(i + 1) / ranks for i in range(ranks)]))
    hot = q.where(F.col("ties") >= F.col("n") * share).select(F.col("quantile").alias("hash"), F.col("n").alias("all")).distinct()
    named = rows.where("sender_domain is not null").join(F.broadcast(hot), "hash")  # at most 1 / share hashes
    return named.groupBy("sender_domain", "all").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("all") * share).select("sender_domain")
