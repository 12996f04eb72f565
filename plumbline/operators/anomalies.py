"""Values that are unusual for their weekday or hour, each with a reason; repeated dates, gaps, series left behind.

A point is compared with the latest values at earlier dates of its series (and of its weekday or hour). A series may
hold most of the table and a date most of a series, so the history is built in bounded steps: each date keeps its
latest few values, windows run inside chunks of dates, and one small row per chunk carries over to the next chunk."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import OperatorError
from ..functions.kinds import BINARY_FLOAT, col, kinds, need_columns, refuse_names, rows_text, shown, unique_names
from ..functions.readers import (day_micros, micros, moment_of, read_as, read_moment, reads_as, reads_as_any,
                                 whole_part)
from ..functions.scalars import number_text
from ..plans.lineage import cut
from ..plans.ordered import CHUNK, KEY, any_of, chunk_of, consecutive_pairs, key_of
from ..plans.ranked import top_per_group
from ..sources.files import in_places, numbered, place
from .profile import nonfinite_counts, refuse_nonfinite

# How many spreads make a value unusual, and what turns a median or mean deviation into a spread.
SPREADS = {"low": 4, "medium": 3, "high": 2}
MEDIAN_SPREAD, MEAN_SPREAD = 1.4826, 1.2533
NEEDED = 4  # earlier values a judged point needs
PATTERNS = ("none", "weekday", "hour of day")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
UNITS = {"day": DAY, "hour": HOUR, "minute": MINUTE, "second": SECOND}
MONTH = 28  # whole days: dates this far apart have no one step
NAMED = 5
GAP_BLOCK = 1 << 12  # dates of a gap that one row lists at most
CHUNK_DATES = 1 << 20  # whole dates a window sees at most
STRETCH = SECOND << 16  # microseconds of a series a window sees at most, a row per second that has times


def _middle(items: str) -> Column:
    """The median of a column of short sorted arrays."""
    n = F.size(items)
    low, high = F.get(F.col(items), F.floor((n - 1) / 2).cast("int")), F.get(F.col(items), F.floor(n / 2).cast("int"))
    return low + (high - low) / 2


def _last_of(items: Column, k: int) -> Column:
    return F.reverse(F.slice(F.reverse(items), 1, k))


def _half_at_least(gap: str, limit: int, scale: int = 1) -> Column:
    """Whether the median of a group's gaps is at least `limit`: more than half are, or, with as many below as not,
    the two middle gaps average to it."""
    g = F.col(gap) * scale
    above, below = F.count_if(g >= limit), F.count_if(g < limit)
    middle = (F.max(F.when(g < limit, g)) + F.min(F.when(g >= limit, g))) / 2
    return F.when(above == below, middle >= limit).otherwise(above > below)


def series_units(times: DataFrame) -> DataFrame:
    """What each series' dates are compared in, in microseconds: whole days when its times are mostly a day or more
    apart (the median gap, to the nearest finer unit), else whole hours, minutes or seconds: (key, unit, lo, hi).
    `times`: (key, t) in microseconds.

    The median itself is not needed: how many gaps reach a unit's limit tells, and the two gaps next to it where as many
    do as do not. So times are put in order within their second (at most a million), seconds within stretches, and
    stretches within the series; the rest is counting. (Half way rounds to even, which all three units are.)"""
    limits = {size: size - finer // 2 for size, finer in ((DAY, HOUR), (HOUR, MINUTE), (MINUTE, SECOND))}
    second = whole_part(F.col("t"), F.lit(SECOND).cast("bigint"))
    different = times.groupBy(KEY, second.alias("second"), "t").agg(F.count("*").alias("rows"))
    inner = F.col("t") - F.lag("t").over(W.partitionBy(KEY, "second").orderBy("t"))
    cells = different.withColumn("gap", inner).groupBy(KEY, "second").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.max("gap").alias("inner"))
    cells = cells.withColumn(CHUNK, chunk_of(F.col("second") * SECOND, STRETCH))
    gap = F.col("first") - F.lag("last").over(W.partitionBy(KEY, CHUNK).orderBy("first"))
    counted = cells.withColumn("gap", gap).groupBy(KEY, CHUNK).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[c.alias(f"{part}_{size}") for size, limit in limits.items() for part, c in (
            ("reach", F.count_if(F.col("gap") >= limit)), ("next", F.min(F.when(F.col("gap") >= limit, F.col("gap")))),
            ("below", F.max(F.greatest(F.when(F.col("gap") < limit, F.col("gap")), F.col("inner")))))])
    between = F.col("first") - F.lag("last").over(W.partitionBy(KEY).orderBy(CHUNK))
    gap = F.col("gap")
    totals = counted.withColumn("gap", between).groupBy(KEY).agg(
        F.sum("n").alias("n"), F.min("first").alias("lo"), F.max("last").alias("hi"),
        *[c.alias(f"{part}_{size}") for size, limit in limits.items() for part, c in (
            ("reach", F.sum(F.col(f"reach_{size}")) + F.count_if(gap >= limit)),
            ("next", F.min(F.least(F.col(f"next_{size}"), F.when(gap >= limit, gap)))),
            ("below", F.max(F.greatest(F.col(f"below_{size}"), F.when(gap < limit, gap)))))])
    unit = F.lit(SECOND)
    for size, limit in reversed(limits.items()):
        reach, rest = F.col(f"reach_{size}"), F.col("n") - 1 - F.col(f"reach_{size}")
        middle = (F.col(f"below_{size}") + F.col(f"next_{size}")) / 2
        mostly = F.when((reach == rest) & (reach > 0), middle >= limit).otherwise(reach > rest)
        unit = F.when(mostly, F.lit(size)).otherwise(unit)
    return totals.select(KEY, unit.cast("bigint").alias("unit"), "lo", "hi")


def latest_earlier_values(points: DataFrame, by: list[str], last: int, chunks: bool) -> DataFrame:
    """For each date of each block: its history, the latest `last` values at earlier dates, oldest first.

    `points`: (*by, whole, row, v), a row per point; v null where missing. Gives (*by, whole, history). A point's row
    number says which of a date's values are its latest. `chunks`: a block may span more than CHUNK_DATES dates."""
    where = [*by, "whole"]
    kept = top_per_group(points, where, [F.col("v").isNull(), F.desc("row")], last, "__rank")
    found = F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("row", "v"))))["v"]
    dates = kept.groupBy(*where).agg(found.alias("h"))
    dates = dates.withColumns({"empty": F.when(F.size("h") == 0, 1).otherwise(0),
                               CHUNK: chunk_of(F.col("whole"), CHUNK_DATES if chunks else None)})
    stretch = [*by, CHUNK]
    # Dates with values get even places, the empty ones between them the odd place after: the `last` dates with values
    # before a date are then one range of places, whichever kind the date is.
    upto = W.partitionBy(*stretch).orderBy("whole").rowsBetween(W.unboundedPreceding, 0)
    placed = dates.withColumn("place", 2 * F.sum(1 - F.col("empty")).over(upto) + F.col("empty"))
    recent = W.partitionBy(*stretch).orderBy("place").rangeBetween(-2 * last, -1)
    arrays = F.sort_array(F.collect_list(F.when(F.col("empty") == 0, F.struct("whole", "h"))).over(recent))["h"]
    inside = placed.withColumn("history", _last_of(F.flatten(arrays), last))
    if not chunks:
        return inside.select(*where, "history")
    inside = cut(inside.select(*where, CHUNK, "h", "history"))
    tails = inside.groupBy(*stretch).agg(F.max_by(_last_of(F.concat("history", "h"), last), "whole").alias("tail"))
    # The same with chunks for dates: those of nothing but missing values leave no tail.
    tails = tails.withColumn("empty", F.when(F.size("tail") == 0, 1).otherwise(0))
    upto = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, 0)
    placed = tails.withColumn("place", 2 * F.sum(1 - F.col("empty")).over(upto) + F.col("empty"))
    recent = W.partitionBy(*by).orderBy("place").rangeBetween(-2 * last, -1)
    before = F.sort_array(F.collect_list(F.when(F.col("empty") == 0, F.struct(CHUNK, "tail"))).over(recent))["tail"]
    carries = placed.withColumn("carry", F.flatten(before)).select(*stretch, "carry")
    joined = inside.join(carries, stretch, "left")
    none = F.array().cast("array<double>")
    return joined.select(*where, _last_of(F.concat(F.coalesce("carry", none), "history"), last).alias("history"))


def usual_range(df: DataFrame, spreads: int) -> DataFrame:
    """Adds band: the expected value, spread, low and high its short `history` gives (null with too few values) and
    how many values it has. (One step per column: an expression used twice would be worked out twice.)"""
    mean = F.aggregate("apart", F.lit(0.0), lambda a, v: a + v) / F.col("count")
    found = df.withColumns({"sorted": F.sort_array("history"), "count": F.size("history")})
    found = found.withColumn("expected", F.when(F.col("count") >= NEEDED, _middle("sorted")))
    found = found.withColumn("apart", F.sort_array(F.transform("history", lambda v: F.abs(v - F.col("expected")))))
    found = found.withColumn("typical", _middle("apart"))
    found = found.withColumn("spread", F.when(F.col("typical") > 0, MEDIAN_SPREAD * F.col("typical"))
                             .when(F.col("count") >= NEEDED, MEAN_SPREAD * mean))
    away = spreads * F.col("spread")
    return found.withColumn("band", F.struct("expected", "spread", (F.col("expected") - away).alias("low"),
                                             (F.col("expected") + away).alias("high"), "count"))


@dataclass
class Anomalies:
    """What detect_anomalies found; each part is a DataFrame worked out when it is first used."""

    _rows: DataFrame  # the input with the internal columns
    _setup: object

    @cached_property
    def table(self) -> DataFrame:
        """The input's columns, then <number>_expected, _low, _high, then anomaly and reason."""
        s = self._setup
        return self._rows.select(*[col(c) for c in s.df.columns], *[col(c) for c in s.added])

    @cached_property
    def anomalies(self) -> DataFrame:
        return self.table.where("anomaly")

    def count(self) -> int:
        return self.anomalies.count()

    @cached_property
    def summary(self) -> DataFrame:
        """Per series and number column: points judged, unusual, with too little history, missing values."""
        s = self._setup
        parts = []
        for j, name in enumerate(s.numbers):
            c = F.col(f"__c{j}")
            parts.append(F.struct(F.lit(name).alias("number"), c["judged"].alias("judged"), c["unusual"].alias("unusual"),
                                  c["short"].alias("short"), c["missing"].alias("missing")))
        long = self._rows.select(KEY, F.explode(F.array(*parts)).alias("p"))
        counted = long.groupBy(KEY, "p.number").agg(
            F.count_if("p.judged").alias("judged"), F.count_if("p.unusual").alias("unusual"),
            F.count_if("p.short").alias("few_history"), F.count_if("p.missing").alias("missing"))
        return counted.select(s.label.alias("series"), "number", "judged", "unusual", "few_history", "missing")

    def chart_data(self, number: str, most: int | None = None) -> DataFrame:
        """The points of every series, or of the first `most`: series, t, value, low, high, unusual."""
        s = self._setup
        j = s.numbers.index(number)
        rows = self._rows
        if most is not None:
            rows = rows.join(rows.select(KEY).distinct().orderBy(KEY).limit(most), KEY, "left_semi")
        return rows.select(
            s.label.alias("series"), F.col("__at").alias("t"), F.col(f"__v{j}").alias("value"),
            col(f"{number}_low").alias("low"), col(f"{number}_high").alias("high"),
            F.col(f"__c{j}")["unusual"].alias("unusual"))

    @cached_property
    def repeated_dates(self) -> DataFrame:
        """Series with dates of more than one row: series, dates, rows, first_dates (5 at most)."""
        s = self._setup
        per_date = s.points.groupBy(KEY, "__unit", "__whole").agg(F.count("*").alias("n")).where("n > 1")
        named = top_per_group(per_date, [KEY], [F.asc("__whole")], NAMED)
        first = named.groupBy(KEY).agg(F.array_join(F.sort_array(F.collect_list(
            F.struct("__whole", s.at(F.col("__whole"), F.col("__unit")).alias("d"))))["d"], ", ").alias("first_dates"))
        totals = per_date.groupBy(KEY).agg(F.count("*").alias("dates"), F.sum("n").alias("rows"))
        return totals.join(s.per_series(first), KEY).select(s.label.alias("series"), "dates", "rows", "first_dates")

    @cached_property
    def behind(self) -> DataFrame:
        """Series with no row at the table's latest date: series, latest (their own), table_latest."""
        s = self._setup
        latest = s.points.groupBy(KEY, "__unit").agg(F.max("__whole").alias("w"))
        table = whole_part(F.lit(s.latest).cast("bigint"), F.col("__unit"))
        return latest.where(F.col("w") != table).select(
            s.label.alias("series"), s.at(F.col("w"), F.col("__unit")).alias("latest"),
            s.at(table, F.col("__unit")).alias("table_latest"))

    @cached_property
    def _steps(self) -> DataFrame:
        """Per series of two dates or more: its usual step in units and why it is not checked for gaps, if it is not."""
        s = self._setup
        apart = s.pairs.withColumn("gap", F.col("next") - F.col("prev"))
        facts = apart.groupBy(KEY).agg(F.count("*").alias("n"), F.min("prev").alias("lo"), F.max("next").alias("hi"),
                                       F.max("unit").alias("unit"),
                                       (F.max(F.col("unit") == DAY) & _half_at_least("gap", MONTH)).alias("monthly"))
        steps = apart.groupBy(KEY, "gap").agg(F.count("*").alias("times"))
        usual = steps.groupBy(KEY).agg(F.max(F.struct("times", -F.col("gap"))).alias("m"))
        both = facts.join(s.per_series(usual), KEY).withColumns({"step": -F.col("m")["col2"], "times": F.col("m")["times"]})
        why = (F.when(F.col("monthly"), "a month or more apart").when(2 * F.col("times") < F.col("n"), "no regular step"))
        return cut(both.select(KEY, "unit", "lo", "hi", "step", why.alias("not_checked")))

    @cached_property
    def _stretches(self) -> DataFrame:
        """Where series miss dates at their usual step, as stretches, a row for each however long: key, unit, step, a and b
        (the first and last missing date), and the weekdays and hours that the series has."""
        s = self._setup
        steps = self._steps.where("not_checked IS NULL").select(KEY, "lo", "step")
        at_us = F.col("__whole") * F.col("__unit")
        has = s.points.groupBy(KEY).agg(F.collect_set(s.weekday_of(at_us)).alias("weekdays"),
                                        F.collect_set(s.hour_of(at_us)).alias("hours"))
        grid = s.pairs.join(s.per_series(steps), KEY).where("next - prev <> step")
        first = F.col("lo") + (F.floor((F.col("prev") - F.col("lo")) / F.col("step")) + 1).cast("bigint") * F.col("step")
        final = F.col("lo") + (F.ceil((F.col("next") - F.col("lo")) / F.col("step")) - 1).cast("bigint") * F.col("step")
        found = grid.withColumns({"a": first, "b": final}).where("a <= b").join(s.per_series(has), KEY)
        return cut(found.select(KEY, "unit", "step", "a", "b", "weekdays", "hours"))

    def _dates_in(self, stretches: DataFrame, last: Column) -> DataFrame:
        """The dates of stretches from a up to `last`, but those on weekdays or at hours that the series never has."""
        s = self._setup
        block = F.col("step") * F.lit(GAP_BLOCK)  # (a long one is listed in blocks, so no row holds all its dates)
        blocks = stretches.withColumn("__to", last).withColumn("__a", F.explode(F.sequence("a", "__to", block)))
        each = blocks.withColumn("w", F.explode(F.sequence("__a", F.least("__to", F.col("__a") + block - F.col("step")), "step")))
        us = F.col("w") * F.col("unit")
        return each.where(F.array_contains("weekdays", s.weekday_of(us)) & F.array_contains("hours", s.hour_of(us)))

    @cached_property
    def missing_dates(self) -> DataFrame:
        """The dates at a series' usual step between its first and last that it has no row at: series, date, step.
        A weekday or an hour a series never has is no gap."""
        s = self._setup
        return self._dates_in(self._stretches, F.col("b")).select(
            KEY, s.label.alias("series"), "w", s.at(F.col("w"), F.col("unit")).alias("date"), _step_text(F.col("step") * F.col("unit")).alias("step"))

    @cached_property
    def gaps(self) -> DataFrame:
        """Per series with gaps or not checked for them: series, step, missing, first_dates (5 at most), not_checked.

        Missing dates are counted, not listed: weekdays and hours come round after a week of steps, so a stretch's first
        week tells how many there are of each place in the week, and which dates are its first."""
        s = self._setup
        around = F.col("step") * (F.lit(7 * DAY) / F.col("unit")).cast("bigint")  # whole weeks, in units
        week = self._dates_in(self._stretches, F.least("b", F.col("a") + around - F.col("step")))
        week = week.withColumn("times", F.floor((F.col("b") - F.col("w")) / around).cast("bigint") + 1)
        early = week.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.least("times", F.lit(NAMED)) - 1), lambda k: F.col("w") + k * around)))
        first = top_per_group(early.select(KEY, "w", "unit"), [KEY], [F.asc("w")], NAMED).groupBy(KEY).agg(F.array_join(F.sort_array(
            F.collect_list(F.struct("w", s.at(F.col("w"), F.col("unit")).alias("date"))))["date"], ", ").alias("first_dates"))
        found = week.groupBy(KEY).agg(F.sum("times").alias("missing"))
        step = _step_text(F.col("step") * F.col("unit"))
        listed = self._steps.join(s.per_series(found), KEY, "left").join(s.per_series(first), KEY, "left")
        return listed.where("missing > 0 OR not_checked IS NOT NULL").select(
            s.label.alias("series"), F.when(F.col("not_checked").isNull(), step).alias("step"),
            F.when(F.col("not_checked").isNull(), F.coalesce("missing", F.lit(0))).alias("missing"),
            "first_dates", "not_checked")

    @cached_property
    def date_warnings(self) -> DataFrame:
        """Repeated dates, gaps and series left behind in one table: series, warning, dates, details."""
        repeated = self.repeated_dates.select("series", F.lit("repeated dates").alias("warning"), "dates",
                                              F.col("first_dates").alias("details"))
        gaps = self.gaps.select("series", F.when(F.col("not_checked").isNull(), "missing dates")
                                .otherwise("not checked for gaps").alias("warning"), F.col("missing").alias("dates"),
                                F.coalesce("not_checked", "first_dates").alias("details"))
        found = repeated.unionByName(gaps)
        if self._setup.only_latest:
            behind = self.behind.select("series", F.lit("no row at the latest date").alias("warning"),
                                        F.lit(None).cast("bigint").alias("dates"), F.col("latest").alias("details"))
            found = found.unionByName(behind)
        return found


def _step_text(us: Column) -> Column:
    text = F.concat(F.format_string("%s", us / SECOND), F.lit(" seconds"))
    for name, size in reversed(UNITS.items()):
        many = F.concat(F.format_number(F.floor(us / size), 0), F.when(us == size, f" {name}").otherwise(f" {name}s"))
        text = F.when(us % size == 0, many).otherwise(text)
    return text


class _Setup:
    """The settings of one detection, its facts, and the input with the columns the plans work with: __t (the date in
    microseconds), __v0... (the numbers), __row, __unit, __whole, __block."""

    def __init__(self, df, date_column, number_columns, group_by, pattern, last, sensitivity, only_latest, row):
        self.df, self.date, self.groups = df, date_column, unique_names(group_by)
        self.numbers = unique_names(number_columns)
        self.pattern, self.last, self.spreads, self.only_latest = pattern, last, SPREADS[sensitivity], only_latest
        self.added = [f"{n}_{part}" for n in self.numbers for part in ("expected", "low", "high")] + ["anomaly", "reason"]
        need_columns(df, [date_column], "Date column")
        need_columns(df, self.numbers, "Number columns")
        need_columns(df, self.groups, "Group by")
        refuse_names(df, self.added, "the detection adds")
        has = kinds(df)
        if has[date_column] not in ("date", "datetime", "text"):
            raise OperatorError(f"Date column: {date_column} is {has[date_column]}: a date, a date and time, or text of "
                                "YYYY-MM-DD or YYYY-MM-DD HH:MM[:SS] is needed")
        wrong = [f"{n} is {has[n]}" for n in self.numbers if has[n] not in ("int", "float", "text")]
        if wrong:
            raise OperatorError(f"Number columns: {'; '.join(wrong)}: numbers, or text of numbers (1234.5), are needed")
        when = (read_moment(col(date_column)) if has[date_column] == "text" else col(date_column)).cast("timestamp_ntz")
        us = day_micros(col(date_column)) if has[date_column] == "date" else micros(when)
        values = [read_as("float", col(n)) if has[n] == "text" else col(n).cast("double") for n in self.numbers]
        if not row:
            df = in_places(df)  # (a busy date's latest values are those that come last in the table)
        order, self.placed = (col(row), False) if row else (place(), True)
        self.base = df.withColumns({KEY: key_of(self.groups), "__t": us, "__at": when, "__row": order,
                                    **{f"__v{j}": v for j, v in enumerate(values)}})
        self._look(has, row)
        labels = [F.coalesce(F.col(KEY)[g].cast("string"), F.lit("(missing)")) for g in self.groups]
        self.label = F.concat_ws(", ", *labels) if labels else F.lit("")

    def _look(self, has, row):
        """One pass over the columns concerned: what does not read, nulls, whether dates have times, the latest date."""
        floats = [f.name for f in self.df.schema if f.name in self.numbers and isinstance(f.dataType, BINARY_FLOAT)]
        d = col(self.date)
        text_date = has[self.date] == "text"
        unread = {}
        if text_date:
            unread[self.date] = (d.isNotNull() & ~reads_as_any(["date", "datetime"], d), "date or datetime")
        for n in self.numbers:
            if has[n] == "text":
                unread[n] = (col(n).isNotNull() & ~reads_as("float", col(n)), "float")
        timed = F.max(F.char_length(F.trim(d)) > 10) if text_date else F.lit(has[self.date] == "datetime")
        facts = self.base.agg(
            F.count("*").alias("rows"), F.count_if(d.isNull()).alias("undated"), F.min("__t").alias("first"),
            F.max("__t").alias("latest"), F.coalesce(F.first(timed) if not text_date else timed, F.lit(False)).alias("timed"),
            *nonfinite_counts(self.df, floats),
            *[F.count_if(bad).alias(f"unread_{i}") for i, (bad, _) in enumerate(unread.values())]).first().asDict()
        for i, (name, (bad, wanted)) in enumerate(unread.items()):
            if facts[f"unread_{i}"]:
                setting = "Date column" if name == self.date else "Number columns"
                raise OperatorError(f"{setting}: " + unread_text(self.df.withColumn("__row", col(row)) if row else numbered(self.df, "__row"),
                                                                name, bad, wanted, "__row"))
        refuse_nonfinite(facts, floats)
        if facts["undated"]:
            raise OperatorError(f"Date column: {self.date} has no value in {rows_text(facts['undated'])}: each row needs "
                                "its date; leave such rows out first")
        self.daily = not facts["timed"]
        if self.pattern == "hour of day" and self.daily:
            raise OperatorError(f"Pattern hour of day: {self.date} has dates without times: choose weekday or none")
        self.rows, self.latest, self.first = facts["rows"], facts["latest"], facts["first"]

    # --- dates -----------------------------------------------------------------------------------------------

    @staticmethod
    def weekday_of(us: Column) -> Column:
        """0 for Monday (1970 began on a Thursday)."""
        return F.pmod(whole_part(us, F.lit(DAY)) + 3, F.lit(7)).cast("int")

    @staticmethod
    def hour_of(us: Column) -> Column:
        return F.pmod(whole_part(us, F.lit(HOUR)), F.lit(24)).cast("int")

    def date_text(self, moment: Column) -> Column:
        if self.daily:
            return F.date_format(moment, "yyyy-MM-dd")
        return F.when(F.second(moment) != 0, F.date_format(moment, "yyyy-MM-dd HH:mm:ss")).otherwise(
            F.date_format(moment, "yyyy-MM-dd HH:mm"))

    def at(self, whole: Column, unit: Column) -> Column:
        """A whole date as warnings name it: the day alone when the unit is days."""
        day = F.date_format(moment_of(whole * unit), "yyyy-MM-dd")
        return day if self.daily else F.when(unit == DAY, day).otherwise(self.date_text(moment_of(whole * unit)))

    @cached_property
    def units(self) -> DataFrame | None:
        """Each series' unit. None where all are days: dates without times are always a day or more apart."""
        return None if self.daily else cut(series_units(self.base.select(KEY, F.col("__t").alias("t"))))

    def per_series(self, df: DataFrame) -> DataFrame:
        """A table of a row per series, to be joined to others: without groups it is one row, and broadcast."""
        return df if self.groups else F.broadcast(df)

    @cached_property
    def chunks(self) -> bool:
        """Whether a series spans more whole dates than a window should see."""
        if (self.latest or 0) - (self.first or 0) < CHUNK_DATES * SECOND:
            return False
        if self.units is None:
            return (self.latest - self.first) // DAY >= CHUNK_DATES
        most = self.units.agg(F.max((F.col("hi") - F.col("lo")) / F.col("unit"))).first()[0]
        return most >= CHUNK_DATES

    @cached_property
    def points(self) -> DataFrame:
        if self.units is None:
            found = self.base.withColumn("__unit", F.lit(DAY).cast("bigint"))
        else:
            found = self.base.join(self.per_series(self.units.select(KEY, F.col("unit").alias("__unit"))), KEY)
        block = {"none": F.lit(0), "weekday": self.weekday_of(F.col("__t")), "hour of day": self.hour_of(F.col("__t"))}
        return found.withColumns({"__whole": whole_part(F.col("__t"), F.col("__unit")),
                                  "__block": block[self.pattern]})

    @cached_property
    def pairs(self) -> DataFrame:
        """Each two neighbouring whole dates of a series: (key, prev, next, unit)."""
        dates = self.points.groupBy(KEY, "__whole").agg(F.max("__unit").alias("unit"))
        spans = dates.select(KEY, F.col("__whole").alias("first"), F.col("__whole").alias("last"))
        found = consecutive_pairs(spans, KEY, "first", "last", [CHUNK_DATES])
        if self.units is None:
            return cut(found.withColumn("unit", F.lit(DAY).cast("bigint")))
        return cut(found.join(self.per_series(self.units.select(KEY, "unit")), KEY))

    # --- judging ---------------------------------------------------------------------------------------------

    def in_order(self) -> DataFrame:
        """The points with a whole number for their place: files are numbered by name, so that what is sorted, a task's
        rows at once, holds no name of a file."""
        if not self.placed:
            return self.points
        names = self.base.select(F.col("__row")["file"].alias("__file")).distinct()  # (a row per file)
        files = F.broadcast(names.withColumn("__nth", F.row_number().over(W.orderBy("__file")).cast("bigint")))
        place_of = F.col("__nth") * F.lit(1 << 40) + F.col("__row")["row"]
        return self.points.join(files, F.col("__row")["file"] == F.col("__file")).withColumn("__row", place_of).drop("__file", "__nth")

    def bands(self) -> DataFrame:
        """Each date's usual range per number column: (key, block, whole, __b0, __b1, ...)."""
        values = [F.struct(F.lit(j).alias("j"), F.col(f"__v{j}").alias("v")) for j in range(len(self.numbers))]
        long = self.in_order().select(KEY, "__block", F.col("__whole").alias("whole"), F.col("__row").alias("row"),
                                  F.explode(F.array(*values)).alias("p")).select(KEY, "__block", "whole", "row", "p.*")
        history = latest_earlier_values(long, [KEY, "__block", "j"], self.last, self.chunks)
        found = usual_range(history, self.spreads)
        at = [KEY, "__block", F.col("whole").alias("__whole")]
        if len(self.numbers) == 1:
            return found.select(*at, F.col("band").alias("__b0"))
        return found.groupBy(*at).agg(*[F.max(F.when(F.col("j") == j, F.col("band"))).alias(f"__b{j}")
                                        for j in range(len(self.numbers))])

    def judged(self) -> DataFrame:
        at_latest = F.col("__whole") == whole_part(F.lit(self.latest).cast("bigint"), F.col("__unit"))
        judge = at_latest if self.only_latest else F.lit(True)
        rows = self.points.join(self.bands(), [KEY, "__block", "__whole"], "left")
        cells = {}
        for j in range(len(self.numbers)):
            v, b = F.col(f"__v{j}"), F.col(f"__b{j}")
            enough = b["count"] >= NEEDED
            sure = judge & v.isNotNull() & enough
            cells[f"__c{j}"] = F.struct(
                (judge & v.isNotNull()).alias("judged"), (judge & v.isNotNull() & ~enough).alias("short"),
                F.coalesce(sure & ((v < b["low"]) | (v > b["high"])), F.lit(False)).alias("unusual"),
                v.isNull().alias("missing"))
        rows = rows.withColumns(cells)
        any_judged = any_of([F.col(c)["judged"] for c in cells])
        any_unusual = any_of([F.col(c)["unusual"] for c in cells])
        made = {}
        for j, n in enumerate(self.numbers):
            made |= {f"{n}_{part}": F.col(f"__b{j}")[part] for part in ("expected", "low", "high")}
        made["anomaly"] = F.when(any_judged, any_unusual)
        # (the texts a reason is put together from are columns of their own: each is worked out once)
        texts = {"__day": F.element_at(F.array(*[F.lit(d) for d in DAYS]), self.weekday_of(F.col("__t")) + 1),
                 "__judge": judge}
        for j in range(len(self.numbers)):
            b = F.col(f"__b{j}")
            texts |= {f"__s{j}": F.struct(
                number_text(F.col(f"__v{j}")).alias("value"), number_text(b["expected"]).alias("expected"),
                F.concat(F.lit(" ("), number_text(b["low"]), F.lit("–"), number_text(b["high"]), F.lit(")")).alias("range"))}
        return rows.withColumns(made).withColumns(texts).withColumn("reason", F.when(F.col("__judge"), self._reason()))

    def _reason(self) -> Column:
        day = F.col("__day")
        head = [F.concat(F.substring(day, 1, 3), F.lit(" "), self.date_text(F.col("__at")))]
        if self.groups:
            head.append(self.label)
        told = F.concat_ws(" · ", *[self._told(j, name, day) for j, name in enumerate(self.numbers)])
        return F.concat(F.concat_ws(", ", *head), F.lit(": "), told)

    def _told(self, j: int, name: str, day: Column) -> Column:
        """What a reason says of one number column."""
        v, b, c, text = F.col(f"__v{j}"), F.col(f"__b{j}"), F.col(f"__c{j}"), F.col(f"__s{j}")
        clock = F.format_string(" at %02d:00", F.col("__block"))
        one, many = {"none": (F.lit("point"), F.lit("points")), "weekday": (day, F.concat(day, F.lit("s"))),
                     "hour of day": (F.concat(F.lit("point"), clock), F.concat(F.lit("points"), clock))}[self.pattern]
        usual = F.concat(text["expected"], text["range"])
        start = F.concat(F.lit(f"{name} "), text["value"])
        same = F.concat(start, F.lit("; the "), b["count"].cast("string"), F.lit(" earlier "), many, F.lit(" were all "),
                        text["expected"])
        odd = F.concat(start, F.lit("; a usual "), one, F.lit(" is "), usual)
        fine = F.concat(start, F.lit("; within the usual range of a "), one, F.lit(": "), usual)
        few = F.concat(F.lit(f"{name}: not enough history: "), b["count"].cast("string"), F.lit(" earlier "), many,
                       F.lit(f", {NEEDED} needed"))
        return (F.when(v.isNull(), F.lit(f"{name}: missing value")).when(b["count"] < NEEDED, few)
                .when(c["unusual"] & (b["spread"] == 0), same).when(c["unusual"], odd).otherwise(fine))


def unread_text(df: DataFrame, name: str, bad: Column, wanted: str, row: str) -> str:
    """What of a text column does not read: how many rows, and up to 5 such values with their rows and first row."""
    values = df.where(bad).groupBy(col(name).alias("v")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    totals = values.agg(F.count("*").alias("values"), F.sum("n").alias("rows")).first()
    top = values.orderBy(F.desc("n"), "first").limit(NAMED).collect()
    listed = ", ".join(f"{shown(v.v)} ({rows_text(v.n)}, the first row {v.first:,})" for v in top)
    more = f", and {totals['values'] - len(top):,} more" if totals["values"] > len(top) else ""
    return (f"{name} is text, and {rows_text(totals['rows'])} have a value that does not read as {wanted}: "
            f"{listed}{more}")


def detect_anomalies(df: DataFrame, date_column: str, number_columns, group_by=(), pattern: str = "weekday",
                     last: int = 8, sensitivity: str = "medium", only_latest: bool = True,
                     row: str | None = None) -> Anomalies:
    """Mark the values unusual for their weekday (or hour of day, or among all), each series against its own past.

    `row`: the column that says the input's order, which decides which of a date's values are its latest; without one,
    the order Spark reads the table in."""
    if isinstance(number_columns, str):
        number_columns = [number_columns]
    if not number_columns:
        raise OperatorError("Number columns: list at least one column of numbers")
    if pattern not in PATTERNS:
        raise OperatorError(f"Pattern: {pattern!r} is none of {', '.join(PATTERNS)}")
    if sensitivity not in SPREADS:
        raise OperatorError(f"Sensitivity: {sensitivity!r} is none of {', '.join(SPREADS)}")
    if last < NEEDED:
        raise OperatorError(f"Last: {last} is too few: {NEEDED} or more")
    if row:
        need_columns(df, [row], "Row")
    setup = _Setup(df, date_column, number_columns, group_by, pattern, last, sensitivity, only_latest, row)
    return Anomalies(setup.judged(), setup)
