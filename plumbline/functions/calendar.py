"""Business days: a calendar of days as a table, and shifts and counts by joining it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..errors import OperatorError
from .kinds import col, need_columns

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MOST_DAYS = 4_000_000  # a calendar holds at most this many: more than all the days a date can name
SMALL_DAYS = 400_000  # up to here (a thousand years) a calendar is broadcast


@dataclass(frozen=True)
class Calendar:
    """A weekend, a holiday table (a DataFrame with a `day` column), days added to and removed from the holidays."""

    weekend: tuple[str, ...] = ("sat", "sun")
    added: tuple[dt.date, ...] = ()
    removed: tuple[dt.date, ...] = ()
    holidays: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        wrong = [d for d in self.weekend if str(d).lower()[:3] not in WEEKDAYS]
        if wrong:
            raise OperatorError(f"weekend: {', '.join(map(str, wrong))} is no day of the week")
        if len({str(d).lower()[:3] for d in self.weekend}) == 7:
            raise OperatorError("weekend: a week has at least one business day")

    def days(self, spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
        """day, is_business and bday_index (the business days up to and with the day), a row per day."""
        if not 0 <= (last - first).days < MOST_DAYS:
            raise OperatorError(f"a calendar from {first} to {last} cannot be made")
        days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
        off = [WEEKDAYS.index(str(d).lower()[:3]) for d in self.weekend]
        holiday = F.col("day").isin(*self.added) if self.added else F.lit(False)
        if self.holidays is not None:
            listed = self.holidays.select(col("day").cast("date").alias("day"), F.lit(True).alias("listed")).distinct()
            days = days.join(listed, "day", "left")
            holiday = holiday | F.col("listed").isNotNull()
        if self.removed:
            holiday = holiday & ~F.col("day").isin(*self.removed)
        business = ~holiday & ~F.weekday("day").isin(*off) if off else ~holiday
        # (one window over the days, of which there are a few hundred a year)
        return days.select("day", business.alias("is_business")).withColumn(
            "bday_index", F.count_if("is_business").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))

    def covering(self, df: DataFrame, columns, most: int = 0) -> tuple[DataFrame, bool]:
        """The calendar over every date of some columns, with room for a shift of `most` business days; and whether it
        is small enough to broadcast."""
        ends = df.agg(*[f(col(c).cast("date")).alias(f"{n}{i}") for i, c in enumerate(columns)
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
        known = [v for v in ends if v is not None] or [dt.date(2000, 1, 1)]
        working = 7 - len({str(d).lower()[:3] for d in self.weekend})
        listed = self.holidays.count() if self.holidays is not None else 0
        room = dt.timedelta(days=(most + len(self.added) + listed) * 7 // working + 14)
        first, last = min(known) - room, max(known) + room
        return self.days(df.sparkSession, first, last), (last - first).days < SMALL_DAYS


WEEKENDS = Calendar()


def _hinted(days: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(days) if small else days


def _looked_up(df: DataFrame, column: str, days: DataFrame, small: bool, *facts: tuple[str, str]) -> DataFrame:
    """The calendar's facts of a date column beside it."""
    picked = days.select(F.col("day").alias("__day"), *[F.col(f).alias(a) for f, a in facts])
    return df.withColumn("__date", col(column).cast("date")).join(
        _hinted(picked, small), F.col("__date") == F.col("__day"), "left").drop("__day")


def shift_business_days(df: DataFrame, column: str, n, into: str, calendar: Calendar = WEEKENDS) -> DataFrame:
    """A date or timestamp n business days on (back when negative), its time kept; 0 leaves it as it is. `n`: a number
    or the name of a whole-number column. Going forward from any day, the first business day after it counts as one."""
    need_columns(df, [column], "Date column")
    amount = col(n).cast("bigint") if isinstance(n, str) else F.lit(n).cast("bigint")
    most = abs(n) if not isinstance(n, str) else (df.agg(F.max(F.abs(amount))).first()[0] or 0)
    days, small = calendar.covering(df, [column], most)
    at = _looked_up(df, column, days, small, ("is_business", "__open"), ("bday_index", "__index"))
    to = F.when(amount >= 0, F.col("__index") + amount).when(F.col("__open"), F.col("__index") + amount) \
        .otherwise(F.col("__index") + amount + 1)
    business = days.where("is_business").select(F.col("bday_index").alias("__to"), F.col("day").alias("__landed"))
    found = at.withColumn("__want", to).join(_hinted(business, small), F.col("__want") == F.col("__to"), "left")
    landed = F.when(amount == 0, F.col("__date")).otherwise(F.col("__landed"))
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        moved = col(column) + F.make_dt_interval(F.datediff(landed, F.col("__date")))
    else:
        moved = landed
    return found.withColumn(into, moved).drop("__date", "__open", "__index", "__want", "__to", "__landed")


def next_business_day(df: DataFrame, column: str, into: str, calendar: Calendar = WEEKENDS) -> DataFrame:
    return shift_business_days(df, column, 1, into, calendar)


def previous_business_day(df: DataFrame, column: str, into: str, calendar: Calendar = WEEKENDS) -> DataFrame:
    return shift_business_days(df, column, -1, into, calendar)


def is_business_day(df: DataFrame, column: str, into: str, calendar: Calendar = WEEKENDS) -> DataFrame:
    need_columns(df, [column], "Date column")
    days, small = calendar.covering(df, [column])
    found = _looked_up(df, column, days, small, ("is_business", "__open"))
    return found.withColumn(into, F.col("__open")).drop("__date", "__open")


def business_days_between(df: DataFrame, start: str, end: str, into: str, calendar: Calendar = WEEKENDS) -> DataFrame:
    """The business days from start up to but without end; negative when end comes first."""
    need_columns(df, [start, end], "Date columns")
    days, small = calendar.covering(df, [start, end])
    before = days.select("day", (F.col("bday_index") - F.col("is_business").cast("int")).alias("before"))
    found = _looked_up(df, start, before, small, ("before", "__a")).drop("__date")
    found = _looked_up(found, end, before, small, ("before", "__b")).drop("__date")
    return found.withColumn(into, F.col("__b") - F.col("__a")).drop("__a", "__b")


def clock_to_utc(wall: Column, zone: str) -> Column:
    """The moment (a UTC clock time) a zone's clock first shows `wall`: of a time shown twice its first, of a time the
    clock skips the moment of the jump."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    # A skipped time is taken with the offset before the jump, which lies at most the jump's length earlier, at a
    # whole second.
    whole = utc - F.make_dt_interval(secs=F.date_part(F.lit("SECOND"), wall) - F.second(wall))
    seconds = F.sequence(whole - (back - wall), whole, F.expr("INTERVAL 1 SECOND"))
    jump = F.get(F.filter(seconds, lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t) >= wall), F.lit(0))
    return F.when(back == wall, utc).otherwise(jump)
