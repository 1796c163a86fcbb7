"""Parsing of mixed date notations into a wall time, a zone and an instant, inside the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and short names of the months in English, German, French, Spanish, Italian, Dutch,
# Polish and Portuguese; a name that two languages share has the same number in both.
MONTHS = {
    1: "jan january januar janv janvier ene enero gen gennaio januari stycznia styczeń sty jänner janeiro",
    2: "feb february februar févr fevr février fevrier febrero febbraio februari lutego luty lut fev fevereiro",
    3: "mar march märz maerz mrz mars marzo maart mrt marca marzec março marco",
    4: "apr april avr avril abr abril aprile kwietnia kwiecień kwi",
    5: "may mai mayo mag maggio mei maja maj maio",
    6: "jun june juni juin junio giu giugno czerwca czerwiec cze junho",
    7: "jul july juli juil juillet julio lug luglio lipca lipiec lip julho",
    8: "aug august août aout agosto ago augustus sierpnia sierpień sie augusti",
    9: "sep sept september septembre septiembre set settembre września wrzesień wrz setembro",
    10: "oct october oktober okt octobre octubre ott ottobre października październik paź outubro",
    11: "nov november novembre noviembre listopada listopad lis novembro",
    12: "dec december dezember dez déc décembre decembre dic diciembre dicembre grudnia grudzień gru dezembro",
}

# Zone abbreviations of mail headers with their offset from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180, "IST": 330, "JST": 540, "AWST": 480, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300,
}

_ZONE = r"(Z|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?(?:\s*\([^)]*\))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
ISO = rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ,]+{_CLOCK})?\s*([ap]m)?\s*{_ZONE}$"
COMPACT = rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?)?()()\s*{_ZONE}$"
WORDED = rf"(?i)^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})\.?\s+(\p{{L}}+)\.?,?\s+(\d{{4}})(?:,?\s+(?:(?:um|at|à|a las|om|alle|o)\s+)?{_CLOCK})?\s*([ap]m)?\s*{_ZONE}$"
NUMERIC = rf"(?i)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:[T ,]+{_CLOCK})?\s*([ap]m)?\s*{_ZONE}$"
EPOCH = r"^(?:/Date\()?(-?\d{10}|-?\d{13}|-?\d{16}|-?\d{19})(?:[+-]\d{4})?(?:\)/)?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def add_wall_time(rows: DataFrame, text: Column, date_order: Column) -> DataFrame:
    """Adds ``__wall``, ``__own``, ``__zone`` and ``__epoch``: the reading of a date string.

    ``__wall`` are the microseconds of the wall time as if it were UTC; ``__own`` the offset in seconds that the
    text itself gives; ``__zone`` the IANA name it gives; ``__epoch`` is set for epoch counts. All are null where
    the text can't be read or names no real date. Missing parts are zero. Each step is a projection of its own, so
    that every pattern is matched once a row and each stage stays small enough for generated code.
    """
    mark, fields = "\u0001", 10
    groups = F.lit(mark.join(f"${n}" for n in range(1, fields + 1)))
    s = F.col("__s")
    out = rows.withColumn("__s", F.regexp_replace(F.trim(text), r"\s+", " ")).withColumn("__order", F.upper(F.trim(date_order)))
    out = out.withColumn(
        "__kind",
        F.when(s.rlike(EPOCH), "epoch").when(s.rlike(r"^\d{4}[-/.]"), "iso").when(s.rlike(r"^\d{8}"), "compact").when(s.rlike(r"^\d{1,2}[-/.]\d"), "numeric").otherwise("worded"),
    )
    kind = F.col("__kind")
    out = out.withColumn(
        "__g",
        F.split(
            F.when(kind == "iso", F.regexp_replace(s, F.lit(ISO), groups)).when(kind == "compact", F.regexp_replace(s, F.lit(COMPACT), groups))
            .when(kind == "numeric", F.regexp_replace(s, F.lit(NUMERIC), groups)).when(kind == "worded", F.regexp_replace(s, F.lit(WORDED), groups)),
            mark,
        ),
    )
    out = out.withColumn("__g", F.when(F.size("__g") == fields, F.col("__g")))
    g = lambda n: F.col("__g")[n - 1]
    months = F.create_map(*[x for number, names in MONTHS.items() for name in names.split() for x in (F.lit(name), F.lit(str(number)))])
    out = out.withColumn("__m", F.when(kind == "worded", F.coalesce(F.try_element_at(months, F.lower(g(2))), F.lit("0"))).otherwise(g(2)))
    out = out.withColumn("__n", F.transform(F.array(g(1), F.col("__m"), g(3), g(4), g(5), g(6)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))))
    n = lambda k: F.col("__n")[k - 1]
    year_first = kind.isin("iso", "compact") | ((kind == "numeric") & (F.col("__order") == "YMD") & (F.length(g(3)) == 2))
    month_first = (kind == "numeric") & (F.col("__order") == "MDY")
    out = out.withColumn("__y", F.when(year_first, n(1)).otherwise(n(3)))
    out = out.withColumn("__y", F.when((kind == "numeric") & (F.col("__y") < 100), F.col("__y") + F.when(F.col("__y") < 70, 2000).otherwise(1900)).otherwise(F.col("__y")))
    out = out.withColumn("__mo", F.when(month_first, n(1)).otherwise(n(2))).withColumn("__d", F.when(year_first, n(3)).when(month_first, n(2)).otherwise(n(1)))
    date_ = F.try_to_date(F.concat_ws("-", F.lpad(F.col("__y").cast("string"), 4, "0"), F.col("__mo").cast("string"), F.col("__d").cast("string")), "y-M-d")
    half = F.lower(g(8))
    hour = F.when(half == "pm", n(4) % 12 + 12).when(half == "am", n(4) % 12).otherwise(n(4))
    out = out.withColumn("__date", F.when(F.col("__y") >= 1, F.unix_date(date_).cast("long"))).withColumn("__h", hour)
    fraction = F.coalesce(F.rpad(g(7), 6, "0").try_cast("long"), F.lit(0))
    wall = F.when(
        (F.col("__h") < 24) & (n(5) < 60) & (n(6) < 60),
        (F.col("__date") * 86400 + F.col("__h") * 3600 + n(5) * 60 + n(6)) * 1_000_000 + fraction,
    )
    zone_text = F.col("__z")
    digits = F.regexp_replace(zone_text, r"\D", "")
    part = lambda a: F.coalesce(F.substring(digits, a, 2).try_cast("int"), F.lit(0))
    offsets = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v * 60))])
    own = F.when(zone_text.rlike(r"^[+-]\d"), F.when(zone_text.startswith("-"), -1).otherwise(1) * (part(1) * 3600 + part(3) * 60)).when(
        zone_text != "", F.try_element_at(offsets, zone_text)
    )
    out = out.withColumn("__wall", wall).withColumn("__z", F.upper(g(9))).withColumn("__own", own.cast("long"))
    out = out.withColumn("__zone", F.when(g(10) != "", g(10)))
    out = out.withColumn("__wall", F.when(~((zone_text != "") & F.col("__own").isNull() & F.col("__zone").isNull()), F.col("__wall")))
    count = F.when(kind == "epoch", F.regexp_extract(s, EPOCH, 1))
    value, width = count.try_cast("long"), F.length(F.regexp_replace(count, "-", ""))
    epoch = F.when(width == 10, value * 1_000_000).when(width == 13, value * 1_000).when(width == 16, value).when(width == 19, F.expr("1") * F.floor(value / 1000).cast("long"))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return out.withColumn("__epoch", epoch).select(*keep, "__wall", "__own", "__zone", "__epoch")


@lru_cache(maxsize=1)
def zone_names() -> frozenset[str]:
    """The IANA names known here."""
    import zoneinfo

    return frozenset(zoneinfo.available_timezones() - {"localtime"})


#: Wall-clock years of the interval table. Before the first no zone has changed its offset; from ``RULES_FROM`` on every zone
#: follows one rule for good, so a later year has the changes of a year of the table with the same calendar.
FIRST_YEAR, RULES_FROM, LAST_YEAR = 1800, 2088, 2127


def _same_calendar() -> dict[tuple[int, bool], int]:
    """The first year from ``RULES_FROM`` on that begins on a weekday (Monday 0) and is a leap year or not."""
    import calendar

    out: dict[tuple[int, bool], int] = {}
    for y in range(RULES_FROM, LAST_YEAR + 1):
        out.setdefault((calendar.weekday(y, 1, 1), calendar.isleap(y)), y)
    return out


def table_time(wall: Column) -> tuple[Column, Column]:
    """``(year, wall)``: the year of the interval table for a wall time (microseconds), and the wall time moved into it."""
    at = F.timestamp_micros(wall)
    year, begins = F.year(at), F.trunc(at, "year")
    leap = F.dayofmonth(F.last_day(F.add_months(begins, 1))) == 29
    stand_in = F.create_map(*[x for (day, is_leap), y in _same_calendar().items() for x in (F.lit(day * 2 + is_leap), F.lit(y))])
    other = F.element_at(stand_in, F.weekday(begins) * 2 + leap.cast("int"))
    moved = wall - (F.datediff(begins, F.make_date(other, F.lit(1), F.lit(1))).cast("long") * (86_400 * 1_000_000))
    late = year > LAST_YEAR
    return F.when(late, other).otherwise(F.greatest(F.lit(FIRST_YEAR), year)), F.when(late, moved).otherwise(wall)


@lru_cache(maxsize=1024)
def zone_intervals(name: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> list[tuple]:
    """One IANA zone's offset intervals by wall-clock year: ``(zone, year, spans)``.

    A span has the wall times ``lo`` (with it), ``hi`` (without it) and ``reach``
    (up to the next span's ``lo``, so that it also holds a skipped hour) in microseconds, and the offset in
    seconds.
    """
    import datetime as dt
    import zoneinfo

    utc, rows = dt.UTC, []
    begin = dt.datetime(first_year, 1, 1, tzinfo=utc)
    steps = range(0, (last_year + 1 - first_year) * 366, 14)
    z = zoneinfo.ZoneInfo(name)
    offset = lambda t, z=z: int(t.astimezone(z).utcoffset().total_seconds())
    spans, start, prev_t, prev = [], None, begin, offset(begin)
    for n in steps[1:]:
        t = begin + dt.timedelta(days=n)
        now = offset(t)
        if now != prev:
            lo, hi = prev_t, t
            while (hi - lo).total_seconds() > 1:
                mid = lo + dt.timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                lo, hi = (mid, hi) if offset(mid) == prev else (lo, mid)
            spans.append((start, int(hi.timestamp()), prev))
            start, prev = int(hi.timestamp()), now
        prev_t = t
    spans.append((start, None, prev))
    far = 1 << 61
    local = [(-far if a is None else (a + o) * 1_000_000, far if b is None else (b + o) * 1_000_000, o) for a, b, o in spans]
    full = [(lo, hi, max(hi, local[i + 1][0]) if i + 1 < len(local) else hi, o) for i, (lo, hi, o) in enumerate(local)]
    at = 0
    for year in range(first_year, last_year + 1):
        y0 = int(dt.datetime(year, 1, 1, tzinfo=utc).timestamp()) * 1_000_000 if year > first_year else -far
        y1 = int(dt.datetime(year + 1, 1, 1, tzinfo=utc).timestamp()) * 1_000_000 if year < last_year else far
        while at < len(full) and full[at][2] <= y0:
            at += 1
        end = at
        while end < len(full) and full[end][0] < y1:
            end += 1
        rows.append((name, year, [x for x in full[at:end] if x[2] > y0]))
    return rows


SPANS = "zone string, year int, spans array<struct<lo:bigint,hi:bigint,reach:bigint,offset_s:bigint>>"


def zone_table(spark: SparkSession, names: list[str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """The interval table of some zones; at most the IANA list times the years, 200,000 rows of some 100 bytes."""
    import pyarrow as pa

    rows = [row for name in sorted(names) if name in zone_names() for row in zone_intervals(name, first_year, last_year)]
    span = pa.struct([(c, pa.int64()) for c in ("lo", "hi", "reach", "offset_s")])
    zones, years, spans = ([r[i] for r in rows] for i in range(3))
    spans = [[dict(zip(("lo", "hi", "reach", "offset_s"), x)) for x in s] for s in spans]
    at = pa.table({"zone": pa.array(zones, pa.string()), "year": pa.array(years, pa.int32()), "spans": pa.array(spans, pa.list_(span))})
    return spark.createDataFrame(at, SPANS)
