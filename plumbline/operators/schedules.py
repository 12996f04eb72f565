"""When schedules were due, and what became of it: due times, misfires, missed and late runs, overlapping runs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import OperatorError
from ..functions.calendar import clock_to_utc
from ..functions.kinds import col, need_columns
from ..functions.readers import micros, moment_of
from ..plans.lineage import cut
from ..plans.ordered import KEY, key_of, running
from .relational import asof_join

# cron's names and ranges, how late still counts as on time, the misfire policies.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
ON_TIME_SECONDS = 120
POLICIES = ("skip", "run_once", "catch_up")
TICKS = 10_000  # times listed from one row at once
_PIECE = re.compile(r"(\*|\w+)(?:-(\w+))?(?:/(\d+))?")


def _cron_values(name: str, text: str) -> list[int]:
    """The numbers one field of a cron line stands for."""
    low, high = FIELDS[name]
    words = {"month": {m: i + 1 for i, m in enumerate(MONTHS)}, "weekday": {d: i for i, d in enumerate(WEEKDAYS)}}

    def number(word: str) -> int:
        found = int(word) if word.isdigit() else words.get(name, {}).get(word)
        if found is None or not low <= found <= high:
            raise OperatorError(f"{text!r}: {word!r} is not a {name} ({low}-{high})")
        return found

    picked: set[int] = set()
    for piece in text.lower().split(","):
        m = _PIECE.fullmatch(piece)
        if not m or (m[1] == "*" and m[2]) or m[3] == "0" or (m[3] and int(m[3]) == 0):
            raise OperatorError(f"cannot read {piece!r} in the {name} field of a cron line")
        first = low if m[1] == "*" else number(m[1])
        # (a step from a single start counts on to the field's end)
        final = high if m[1] == "*" else number(m[2]) if m[2] else high if m[3] else first
        if first > final:
            raise OperatorError(f"{text!r} is out of range for the {name} field ({low}-{high})")
        picked.update(range(first, final + 1, int(m[3] or 1)))
    return sorted({v % 7 for v in picked} if name == "weekday" else picked)


def parse_cron(line: str) -> dict:
    """A cron line's five sets of numbers, and whether its day and weekday fields are both restricted (either then is
    enough for a day to match)."""
    parts = line.split()
    if len(parts) != len(FIELDS):
        raise OperatorError(f"cron needs 5 fields (minute, hour, day of the month, month, weekday), got {line!r}")
    found = {f"{name}s": _cron_values(name, text) for name, text in zip(FIELDS, parts)}
    return {**found, "either": parts[2] != "*" and parts[4] != "*"}


_NUMBERS = T.ArrayType(T.IntegerType())
CRON_TYPE = T.StructType([*[T.StructField(f"{name}s", _NUMBERS) for name in FIELDS], T.StructField("either", T.BooleanType())])


_ARROW_TYPE = pa.struct([*[pa.field(f"{name}s", pa.list_(pa.int32())) for name in FIELDS], pa.field("either", pa.bool_())])


@F.arrow_udf(CRON_TYPE)
def _parsed(lines: pa.Array) -> pa.Array:
    texts = lines.to_pylist()
    seen = {line: parse_cron(line) for line in set(texts) if line is not None}
    empty = {**{f"{n}s": None for n in FIELDS}, "either": None}
    return pa.array([seen.get(line, empty) for line in texts], _ARROW_TYPE)


def _moment(value) -> Column:
    return col(value) if isinstance(value, str) else F.lit(value.isoformat(" ")).cast("timestamp_ntz")


def cron_due(schedules: DataFrame, after, until, cron: str = "cron") -> DataFrame:
    """Each schedule's due times in (after, until]: its columns and due_at. `after`, `until`: a time or a column."""
    need_columns(schedules, [cron], "Schedules")
    ours = [col(c) for c in schedules.columns]
    found = schedules.withColumns({"__c": _parsed(col(cron)), "__after": _moment(after), "__until": _moment(until)})
    days = found.where("__after < __until").select(*ours, "__c", "__after", "__until", F.explode(
        F.sequence(F.col("__after").cast("date"), F.col("__until").cast("date"))).alias("__day"))
    c = F.col("__c")
    in_days = F.array_contains(c["days"], F.dayofmonth("__day"))
    in_week = F.array_contains(c["weekdays"], (F.dayofweek("__day") - 1))
    match = F.when(c["either"], in_days | in_week).otherwise(in_days & in_week)
    due_days = days.where(F.array_contains(c["months"], F.month("__day")) & match)
    hours = due_days.select(*ours, "__c", "__after", "__until", "__day", F.explode(c["hours"]).alias("__hour"))
    times = hours.select(*ours, "__after", "__until", "__day", "__hour", F.explode(c["minutes"]).alias("__minute"))
    due = F.col("__day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("__hour"), F.col("__minute"))
    return times.withColumn("due_at", due).where("due_at > __after AND due_at <= __until").select(*ours, "due_at")


def every_interval(text: Column) -> Column:
    """"5 minutes" or "2 hours" in microseconds; null where the text is neither."""
    form = r"\A\s*([1-9][0-9]*) *(minute|hour)s?\s*\z"
    n = F.regexp_extract(text, form, 1).try_cast("bigint")
    unit = F.when(F.regexp_extract(text, form, 2) == "hour", F.lit(3_600_000_000)).otherwise(F.lit(60_000_000))
    return F.when(text.rlike(form), n * unit)


def every_due(schedules: DataFrame, after, until, every: str = "every", start: str = "start") -> DataFrame:
    """The times start, start + N, ... (and start - N, ...) in (after, until] of "every N minutes or hours"."""
    need_columns(schedules, [every, start], "Schedules")
    ours = [col(c) for c in schedules.columns]
    found = schedules.withColumns({"__step": every_interval(col(every)), "__start": micros(col(start)),
                                   "__a": micros(_moment(after)), "__u": micros(_moment(until))})
    first = F.floor((F.col("__a") - F.col("__start")) / F.col("__step")) + 1
    final = F.floor((F.col("__u") - F.col("__start")) / F.col("__step"))
    ticks = found.withColumns({"__first": first, "__final": final}).where("__first <= __final")
    blocks = ticks.withColumn("__block", F.explode(F.sequence(
        F.floor(F.col("__first") / TICKS), F.floor(F.col("__final") / TICKS))))
    low = F.greatest("__first", F.col("__block") * TICKS)
    high = F.least("__final", F.col("__block") * TICKS + (TICKS - 1))
    each = blocks.withColumn("__tick", F.explode(F.sequence(low, high)))
    return each.select(*ours, moment_of(F.col("__start") + F.col("__tick") * F.col("__step")).alias("due_at"))


def once_due(schedules: DataFrame, after, until, at: str = "at") -> DataFrame:
    """One-off times in (after, until]."""
    need_columns(schedules, [at], "Schedules")
    when = col(at).cast("timestamp_ntz")
    return schedules.withColumn("due_at", when).where((when > _moment(after)) & (when <= _moment(until)))


def due_times(schedules: DataFrame, after, until) -> DataFrame:
    """Due times in (after, until] of a table of schedules, each with one of cron, every (with start) and at."""
    parts = []
    if "cron" in schedules.columns:
        parts.append(cron_due(schedules.where("cron IS NOT NULL"), after, until))
    if "every" in schedules.columns:
        parts.append(every_due(schedules.where("every IS NOT NULL"), after, until))
    if "at" in schedules.columns:
        parts.append(once_due(schedules.where("at IS NOT NULL"), after, until))
    if not parts:
        raise OperatorError("Schedules: one of the columns cron, every and at is needed")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def due_instants(due: DataFrame, zone: str) -> DataFrame:
    """Due times on a zone's clock as moments: due_utc."""
    return due.withColumn("due_utc", clock_to_utc(F.col("due_at"), zone))


def misfire(due: DataFrame, now, policy: str = "misfire", key: str = "schedule_id") -> DataFrame:
    """What to do with each due time that has come, by its schedule's policy: run_once runs the latest (the others are
    folded into it), catch_up runs all, skip runs the latest if it is less than two minutes late (the others are
    missed). Adds action: run, folded or missed."""
    need_columns(due, [key, "due_at", policy], "Due times")
    latest = due.groupBy(col(key)).agg(F.max("due_at").alias("__latest"))  # (a row per schedule)
    newest = F.col("due_at") == F.col("__latest")
    late = (micros(_moment(now)) - micros(F.col("due_at"))) / 1_000_000
    action = (F.when(col(policy) == "catch_up", "run")
              .when(col(policy) == "run_once", F.when(newest, "run").otherwise("folded"))
              .when(col(policy) == "skip", F.when(newest & (late < ON_TIME_SECONDS), "run").otherwise("missed")))
    return due.join(latest, key).withColumn("action", action).drop("__latest")


def missed_runs(due: DataFrame, starts: DataFrame, key: str = "schedule_id", started: str = "started") -> DataFrame:
    """Each due time with the first start that answers it: schedule, due_at, started, outcome (on time, late, missed).
    A start answers the latest time due at or before it."""
    need_columns(due, [key, "due_at"], "Due times")
    need_columns(starts, [key, started], "Starts")
    times = cut(due.select(key, "due_at").distinct())  # (worked out once, used three times)
    answered = asof_join(starts.select(key, started), times.withColumn("__due", F.col("due_at")), key, started, "__due",
                         ["due_at"])
    first = answered.where("due_at IS NOT NULL").groupBy(key, "due_at").agg(F.min(started).alias("started"))
    found = times.join(first, [key, "due_at"], "left")
    late = (micros(F.col("started")) - micros(F.col("due_at"))) / 1_000_000
    outcome = F.when(F.col("started").isNull(), "missed").when(late < ON_TIME_SECONDS, "on time").otherwise("late")
    return found.withColumn("outcome", outcome)


def overlapping_runs(runs: DataFrame, by, run: str, started: str, finished: str) -> DataFrame:
    """Runs that began while an earlier run of the same flow was still going: their columns and busy_until.

    Each run needs only the latest end among the runs before it: a running maximum, carried across chunks of runs, so a
    flow that has most of them is still many tasks."""
    by = [by] if isinstance(by, str) else list(by)
    need_columns(runs, [*by, run, started, finished], "Runs")
    keyed = runs.withColumn(KEY, key_of(by))
    found = running(keyed, KEY, [started, run], {"busy_until": ("max", finished)}, before=True)
    return found.where(col(started) < F.col("busy_until")).drop(KEY)
