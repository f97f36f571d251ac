"""Dates from text: one layout per column (C-01), read off the texts themselves, and month arithmetic.

A text is cut once into its parts: up to three date fields, what separates them, and an
optional time with AM/PM and zone. The parts' kinds give the text's shape
(``n/n/Y``, ``n-b-Y``, …), and the shape leaves few readings, i.e. which field is the
year, the month and the day. Shapes and readings are summed up over a column with plain
aggregates (least and greatest shape, failures per reading), so the column's one layout
comes out of a single pass, whatever its texts look like:

- all texts have one shape, and the layout is the first reading that fails for none;
- readings are tried month first, then day first, then year first;
- years of two digits are 1969 to 2068; a missing day is the first of the month, so
  ``Jan-24`` is January 2024; the time may be missing in some rows;
- a zone shifts the instant to the session's zone, of which the local time is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names of months and days.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTH_NUMBERS = {name: i + 1 for i, m in enumerate(MONTHS) for name in {m, m[:3]}} | {"sept": 9}

_FIELD = r"(\d{1,2}|\d{4}|\d{8}|[A-Za-z]{3,9})\.?"
_GAP = r"( ?[-/.,] ?| )"
_WEEKDAY = r"(?:(?:" + "|".join(f"{d}|{d[:3]}" for d in DAYS) + r"),? )?"
_TIME = r"(\d{1,2}):([0-5]\d)(?::([0-5]\d)(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?(Z|UTC|GMT|[+-](?:0\d|1[0-7]):?[0-5]\d))?"
PATTERN = (rf"(?i)^{_WEEKDAY}{_FIELD}(?:{_GAP}{_FIELD}(?:{_GAP}{_FIELD})?)?"
           rf"(?:(?:T| |, ){_TIME}(?: ?([AP])\.?M\.?)?{_ZONE})?$")
_PARTS = ("f1", "g1", "f2", "g2", "f3", "hour", "minute", "second", "fraction", "half", "zone")
_MARK = "\u0001"

# Which field is (year, month, day), and which shapes may be read so; n is a number of
# one or two digits, Y one of four, D one of eight, b a name.
READINGS = {
    "month first": ((3, 1, 2), ("nnY", "nnn", "bnY", "bnn")),
    "day first": ((3, 2, 1), ("nnY", "nnn", "nbY", "nbn")),
    "year first": ((1, 2, 3), ("Ynn", "nnn", "Ybn")),
    "month and year": ((2, 1, 0), ("nY", "bY", "bn")),
    "year and month": ((1, 2, 0), ("Yn", "Yb")),
    "year": ((1, 0, 0), ("Y",)),
    "digits": ((0, 0, 0), ("D",)),
}


def with_readings(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds a struct of a text's shape (null where it is no date) and its value in each reading.

    One regular expression cuts a text, and all readings work on its numbers. The steps are
    bound by ``transform``, so each is computed once, and ``explode`` keeps the optimizer from
    merging them into the many expressions that read the struct.
    """
    text = F.trim(F.regexp_replace(F.col(raw).cast("string"), r"\s+", " "))
    groups = _MARK.join(f"${i + 1}" for i in range(len(_PARTS)))
    cut = F.split(F.regexp_replace(text, PATTERN, groups), _MARK, -1)
    read_all = F.transform(F.transform(F.array(cut), _numbers), lambda p: F.struct(
        p["shape"].alias("shape"), F.array(*[read(p, r) for r in READINGS]).alias("values")))
    return df.select("*", F.explode(read_all).alias(name))


def _numbers(cut: Column) -> Column:
    known = F.size(cut) == len(_PARTS)
    part = {n: F.when(known, F.get(cut, F.lit(i))) for i, n in enumerate(_PARTS)}
    fields = [part[f] for f in ("f1", "f2", "f3")]
    kinds = [_kind(f) for f in fields]
    # No cast ever fails: a failed try_cast costs an exception.
    hour = F.when(part["hour"] == "", 0).otherwise(part["hour"].cast("int"))
    half = F.upper(part["half"])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    second = F.concat(F.lpad(part["second"], 2, "0"), F.lit("."), F.rpad(F.substring(part["fraction"], 1, 6), 6, "0"))
    zone = F.upper(part["zone"])
    return F.struct(
        F.when(known, F.concat(kinds[0], _gap(part["g1"]), kinds[1], _gap(part["g2"]), kinds[2])).alias("shape"),
        F.when(known, F.concat(*kinds)).alias("kinds"), part["f1"].alias("text"),
        F.array(*[_number(f, k) for f, k in zip(fields, kinds)]).alias("n"),
        hour.alias("hour"), F.when(part["minute"] == "", 0).otherwise(part["minute"].cast("int")).alias("minute"),
        second.cast("decimal(8,6)").alias("second"),
        F.when(zone == "", "").when(zone.isin("Z", "GMT"), "UTC").otherwise(F.regexp_replace(zone, "^([+-]..):?", "$1:")).alias("zone"))


def _kind(field: Column) -> Column:
    size = F.length(field)
    return (F.when(size == 0, "").when(field.rlike("^[A-Za-z]"), "b")
            .when(size <= 2, "n").when(size == 4, "Y").otherwise("D"))


def _gap(gap: Column) -> Column:
    bare = F.trim(gap)
    return F.when((bare == "") | (bare == ","), F.when(gap == "", "").otherwise(" ")).otherwise(bare)


def _number(field: Column, kind: Column) -> Column:
    """A field's number, or that of the month it names."""
    names = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
    return F.when(kind.isin("n", "Y", "D"), field.cast("int")).when(kind == "b", F.element_at(names, F.lower(field)))


def read(parts: Column, reading: str) -> Column:
    """The parts read one way, as a zone-free timestamp; null where that isn't a date."""
    (y, m, d), shapes = READINGS[reading]
    kinds = parts["kinds"]
    if reading == "digits":
        year, month, day = (F.substring(parts["text"], *p).cast("int") for p in ((1, 4), (5, 2), (7, 2)))
    else:
        n = parts["n"]
        year = n[y - 1]
        year = F.when(F.substring(kinds, y, 1) == "Y", year).otherwise(year + F.when(year >= 69, 1900).otherwise(2000))
        month, day = (n[i - 1] if i else F.lit(1) for i in (m, d))
    when = [year, month, day, parts["hour"], parts["minute"], parts["second"]]
    return F.when(kinds.isin(*shapes), F.when(parts["zone"] == "", F.try_make_timestamp_ntz(*when))
                  .otherwise(F.try_make_timestamp(*when, parts["zone"]).cast("timestamp_ntz")))


def layout(df: DataFrame, readings: str, raw: str) -> Column:
    """Place of the column's reading in ``READINGS`` as a lazy scalar subquery; null if no one layout fits.

    One aggregate over the column ``readings`` of ``with_readings``; rows without a ``raw``
    text don't count, and a column of such rows alone has the first layout.
    """
    present, r = F.col(raw).isNotNull(), F.col(readings)
    got = df.agg(F.min(r["shape"]).alias("least"), F.max(r["shape"]).alias("most"),
                 *[F.count_if(present & r["values"][i].isNull()).alias(f"bad_{i}") for i in range(len(READINGS))])
    first = F.coalesce(*[F.when(F.col(f"bad_{i}") == 0, F.lit(i)) for i in range(len(READINGS))])
    return got.select(F.when(F.col("least").eqNullSafe(F.col("most")), first).alias("layout")).scalar()


def parsed(readings: Column, index: Column) -> Column:
    """The reading that ``layout`` names; null where it names none."""
    return F.get(readings["values"], index)


def parse_with(col: Column, fmt: str) -> Column:
    """Parse text with one given format to a zone-free timestamp (in the session's zone)."""
    return F.try_to_timestamp(F.trim(col.cast("string")), F.lit(fmt)).cast("timestamp_ntz")


def format_index(df: DataFrame, col: str, formats: Sequence[str]) -> Column:
    """Index of the first given format that parses every present value, as a lazy
    scalar subquery (null when none does)."""
    bad = [F.count_if(F.col(col).isNotNull() & parse_with(F.col(col), f).isNull()).alias(f"bad_{i}") for i, f in enumerate(formats)]
    first = F.coalesce(*[F.when(F.col(f"bad_{i}") == 0, F.lit(i)) for i in range(len(formats))], F.lit(None).cast("int"))
    return df.agg(*bad).select(first.alias("fmt")).scalar()


def add_months(date: Column, n: Column | int) -> Column:
    """date + n months with end-of-month clamping (Jan 31 + 1 → Feb 28/29)."""
    return F.add_months(date, n if isinstance(n, Column) else F.lit(n)).cast("timestamp_ntz")


def add_periods(date: Column, n: Column | int, grain: str = "month") -> Column:
    """date + n periods; months, quarters and years clamp to the month's end."""
    n = n if isinstance(n, Column) else F.lit(n)
    months = {"month": 1, "quarter": 3, "year": 12}
    if grain in months:
        return add_months(date, n * months[grain])
    if grain not in ("day", "week"):
        raise ValueError("grain must be day, week, month, quarter or year")
    return F.date_add(date, n * (7 if grain == "week" else 1)).cast("timestamp_ntz")
