"""Reading text columns as numbers, dates and yes/no, by fixed written forms.

A cast alone is too lax ('2026-1-5' casts to a date), so each reader is a pattern and a try_cast together.
Spaces around a value do not count; a null reads as null."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# The written forms that count as a value of each kind.
INT_FORM = r"[+-]?[0-9]+"
NUMBER_FORM = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
DATE_FORM = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME_FORM = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")


def _matches(text: Column, form: str) -> Column:
    return text.rlike(rf"\A(?:{form})\z")


def read_as(kind: str, value: Column) -> Column:
    """The value of a text column read as `kind` (int, float, date, datetime, bool); null where it does not read."""
    text = F.trim(value)
    if kind == "int":
        return F.when(_matches(text, INT_FORM), text.try_cast("decimal(38,0)"))
    if kind == "float":
        return F.when(_matches(text, NUMBER_FORM), text.try_cast("double"))
    if kind == "date":
        return F.when(_matches(text, DATE_FORM), text.try_cast("date"))
    if kind == "datetime":
        return F.when(_matches(text, f"{DATE_FORM}[ T]{TIME_FORM}"), text.try_cast("timestamp_ntz"))
    if kind == "bool":
        word = F.lower(text)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    raise ValueError(f"no reader for {kind!r}")


def reads_as(kind: str, value: Column) -> Column:
    """Whether a text value reads as `kind` (null for a null). A whole number of any length reads as int."""
    if kind == "int":
        return _matches(F.trim(value), INT_FORM)
    if kind == "float":
        return _matches(F.trim(value), NUMBER_FORM)
    if kind == "text":
        return value.isNotNull()
    return F.when(value.isNotNull(), read_as(kind, value).isNotNull())


def reads_as_any(kinds: list[str], value: Column) -> Column:
    found = reads_as(kinds[0], value)
    for kind in kinds[1:]:
        found = found | reads_as(kind, value)
    return found


def read_moment(value: Column) -> Column:
    """Text holding a date or a date and time, as a zone-less timestamp (a date is its midnight)."""
    return F.coalesce(read_as("datetime", value), read_as("date", value).cast("timestamp_ntz"))


DAY_MICROS = 86_400_000_000
PLAIN_ZONES = ("UTC", "Etc/UTC", "Z", "GMT")


def whole_part(a: Column, b: Column) -> Column:
    """a // b of whole numbers, rounded down."""
    return F.call_function("div", a - F.pmod(a, b), b)


def day_micros(day: Column) -> Column:
    """Microseconds from 1970 to a date."""
    return F.unix_date(day).cast("bigint") * F.lit(DAY_MICROS)


def micros(moment: Column) -> Column:
    """Microseconds from 1970 to a date or timestamp on its own clock (no time zone arithmetic)."""
    clock = moment.cast("timestamp_ntz")
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in PLAIN_ZONES:
        return F.unix_micros(clock.cast("timestamp"))
    seconds = (F.hour(clock) * 3600 + F.minute(clock) * 60).cast("bigint")
    fraction = (F.date_part(F.lit("SECOND"), clock) * 1_000_000).cast("bigint")
    return day_micros(clock.cast("date")) + seconds * F.lit(1_000_000) + fraction


def moment_of(us: Column) -> Column:
    """The zone-less timestamp that many microseconds after 1970."""
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in PLAIN_ZONES:
        return F.timestamp_micros(us).cast("timestamp_ntz")
    day_us = F.lit(DAY_MICROS)
    days = whole_part(us, day_us).cast("int")
    rest = F.pmod(us, day_us)
    midnight = F.date_from_unix_date(days).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))
