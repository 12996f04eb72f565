"""Queries of the calendar and schedule operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import (Calendar, business_days_between, clock_to_utc, is_business_day, next_business_day,
                                  previous_business_day, shift_business_days)
from ..operators.schedules import cron_due, due_times, every_due, misfire, missed_runs, once_due, overlapping_runs
from .registry import query

HOLIDAYS = (dt.date(1995, 12, 25), dt.date(1996, 1, 1), dt.date(1998, 7, 3), dt.date(2000, 12, 25))
CALENDAR = Calendar(weekend=("fri", "sat"), added=HOLIDAYS, removed=(dt.date(1996, 1, 1),))
# The calendar's days with how many business days there are up to and with each.
DAYS = """days as (select day, open, sum(open::int) over (order by day)::bigint as idx from
            (select day, (isodow(day) not in (5, 6) and day not in (date '1995-12-25', date '1998-07-03', date '2000-12-25')) as open
             from (select unnest(generate_series(date '1994-06-01', date '2002-06-01', interval 1 day))::date as day)))"""


@query(f"""with {DAYS}, b as (select idx, day from days where open),
    o as (select o_orderkey, o_orderdate::date as d, o_custkey % 21 - 10 as n from orders)
    select o_orderkey, n, case when n = 0 then d else b.day end::varchar as due
    from o join days on days.day = d
    left join b on b.idx = days.idx + n + (case when n < 0 and not days.open then 1 else 0 end)""")
def business_day_shift(t):
    orders = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 21 - 10).alias("n"))
    return shift_business_days(orders, "d", "n", "due", CALENDAR).select("o_orderkey", "n", F.col("due").cast("string").alias("due"))


@query(f"""with {DAYS}
    select l_orderkey, l_linenumber, l_partkey, l_quantity, (b.idx - b.open::int) - (a.idx - a.open::int) as between_days
    from lineitem join orders on o_orderkey = l_orderkey join days a on a.day = o_orderdate::date
    join days b on b.day = l_shipdate::date""")
def business_days_between_dates(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = business_days_between(lines, "o_orderdate", "l_shipdate", "between_days", CALENDAR)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "between_days")


@query(f"""with {DAYS}
    select event_id, (isodow(ts) < 6) as working,
           (case isodow(ts) when 5 then ts + interval 3 day when 6 then ts + interval 2 day else ts + interval 1 day end)::varchar as next,
           (case isodow(ts) when 1 then ts - interval 3 day when 7 then ts - interval 2 day else ts - interval 1 day end)::varchar
             as previous from events""")
def business_day_neighbours(t):
    found = is_business_day(t.events.select("event_id", "ts"), "ts", "working")
    found = previous_business_day(next_business_day(found, "ts", "next"), "ts", "previous")
    return found.select("event_id", "working", F.date_format("next", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next"),
                        F.date_format("previous", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("previous")).withColumns(
        {c: F.regexp_replace(c, r"\.?0+$", "") for c in ("next", "previous")})


@query("""select event_id, (timezone('Europe/Berlin', ts + interval 90 day) at time zone 'UTC')::varchar as utc
          from events where not (ts + interval 90 day between timestamp '2024-03-31 02:00:00' and timestamp '2024-03-31 03:00:00')
          union all select event_id, '2024-03-31 01:00:00' from events
          where ts + interval 90 day between timestamp '2024-03-31 02:00:00' and timestamp '2024-03-31 03:00:00'""")
def clock_moments(t):
    wall = F.col("ts") + F.expr("interval 90 day")
    utc = F.date_format(clock_to_utc(wall, "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.events.select("event_id", F.regexp_replace(utc, r"\.?0{1,6}$", "").alias("utc"))


AFTER, UNTIL = dt.datetime(2023, 12, 30, 9, 40), dt.datetime(2024, 2, 15, 10, 5)


def _schedules(t) -> DataFrame:
    """A schedule per supplier, of three kinds of cron lines."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    daily = F.concat_ws(" ", key % 60, nation % 24, F.lit("* *"), key % 7)
    either = F.concat_ws(" ", F.lit("*/20"), nation % 24, key % 28 + 1, F.lit("*"), F.lit("mon-wed"))
    stepped = F.concat_ws(" ", F.concat(key % 10, F.lit("/25")), F.lit("8-10 * JAN,mar *"))
    return t.supplier.select(F.col("s_suppkey").alias("schedule_id"),
                             F.when(key % 3 == 0, daily).when(key % 3 == 1, either).otherwise(stepped).alias("cron"))


_DUE = """s as (select s_suppkey as k, s_nationkey as n from supplier),
    days as (select unnest(generate_series(date '2023-12-30', date '2024-02-15', interval 1 day))::date as day),
    d as (select k, n, day, unnest(case when k % 3 = 2 then [8, 9, 10] else [(n % 24)::int] end) as h,
                 case k % 3 when 0 then [(k % 60)::int] when 1 then [0, 20, 40]
                 else list_filter(range(0, 60), lambda m: m >= k % 10 and (m - k % 10) % 25 = 0) end as ms
          from s cross join days
          where case k % 3 when 0 then isodow(day) % 7 = k % 7 when 1 then day(day) = k % 28 + 1 or isodow(day) <= 3
                else month(day) in (1, 3) end),
    due as (select k as schedule_id, day + to_hours(h) + to_minutes(unnest(ms)) as due_at from d),
    due_now as (select * from due where due_at > timestamp '2023-12-30 09:40:00' and due_at <= timestamp '2024-02-15 10:05:00')"""


@query(f"with {_DUE} select schedule_id, due_at::varchar as due_at from due_now")
def cron_due_times(t):
    return cron_due(_schedules(t), AFTER, UNTIL).select("schedule_id", F.col("due_at").cast("string").alias("due_at"))


@query("""with c as (select c_custkey as schedule_id, c_custkey % 50 + 30 as n, timestamp '2024-01-01 00:10:00' as start from customer)
    select schedule_id, (start + to_minutes(n * i))::varchar as due_at
    from c, generate_series(-2000, 2000) g(i) where start + to_minutes(n * i) > timestamp '2023-12-30 09:40:00'
    and start + to_minutes(n * i) <= timestamp '2024-01-03'""")
def every_due_times(t):
    plans = t.customer.select(F.col("c_custkey").alias("schedule_id"), F.concat(F.col("c_custkey") % 50 + 30, F.lit(" minutes")).alias("every"),
                              F.lit("2024-01-01 00:10:00").cast("timestamp_ntz").alias("start"))
    found = every_due(plans, AFTER, dt.datetime(2024, 1, 3))
    return found.select("schedule_id", F.col("due_at").cast("string").alias("due_at"))


@query("""select o_orderkey as schedule_id, o_orderdate::varchar as due_at from orders
          where o_orderdate > timestamp '1997-01-01' and o_orderdate <= timestamp '1999-01-01'""")
def once_due_times(t):
    plans = t.orders.select(F.col("o_orderkey").alias("schedule_id"), F.col("o_orderdate").alias("at"))
    found = once_due(plans, dt.datetime(1997, 1, 1), dt.datetime(1999, 1, 1))
    return found.select("schedule_id", F.col("due_at").cast("string").alias("due_at"))


@query("""select 'cron' as kind, s_suppkey as schedule_id, 47::bigint as times from supplier
          union all select 'every', s_suppkey, 24 * 47::bigint from supplier
          union all select 'at', s_suppkey, 1::bigint from supplier""")
def due_times_of_all_kinds(t):
    base = t.supplier.select(F.col("s_suppkey").alias("schedule_id"))
    none, moment = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    plans = (base.select("schedule_id", F.lit("cron").alias("kind"), F.lit("0 12 * * *").alias("cron"), none.alias("every"),
                         moment.alias("start"), moment.alias("at"))
             .union(base.select("schedule_id", F.lit("every"), none, F.lit("1 hour"), first, moment))
             .union(base.select("schedule_id", F.lit("at"), none, none, moment, first)))
    found = due_times(plans, dt.datetime(2023, 12, 30), dt.datetime(2024, 2, 15))
    return found.groupBy("kind", "schedule_id").agg(F.count("*").alias("times"))


@query(f"""with {_DUE}, p as (select due_now.*, ['run_once', 'catch_up', 'skip'][(n % 3 + 1)::int] as misfire
                              from due_now join s on k = schedule_id),
    l as (select schedule_id, max(due_at) as latest from p group by schedule_id)
    select schedule_id, misfire, due_at::varchar as due_at,
           case misfire when 'catch_up' then 'run' when 'run_once' then case when due_at = latest then 'run' else 'folded' end
           else case when due_at = latest and epoch(timestamp '2024-02-15 10:05:30') - epoch(due_at) < 120 then 'run' else 'missed' end
           end as action
    from p join l using (schedule_id)""")
def misfire_selection(t):
    policy = t.supplier.select(F.col("s_suppkey").alias("schedule_id"), F.element_at(
        F.array(F.lit("run_once"), F.lit("catch_up"), F.lit("skip")), F.col("s_nationkey") % 3 + 1).alias("misfire"))
    due = cron_due(_schedules(t), AFTER, UNTIL).drop("cron").join(policy, "schedule_id")
    found = misfire(due, dt.datetime(2024, 2, 15, 10, 5, 30))
    return found.select("schedule_id", "misfire", F.col("due_at").cast("string").alias("due_at"), "action")


@query("""with u as (select distinct user_id from events),
    due as (select user_id, unnest(generate_series(timestamp '2024-01-01 06:00:00', timestamp '2024-01-30 18:00:00', interval 6 hour))
            as due_at from u),
    a as (select user_id, time_bucket(interval 6 hour, ts) as due_at, min(ts) as started from events group by all)
    select user_id as schedule_id, due.due_at::varchar as due_at, started::varchar as started,
           case when started is null then 'missed' when epoch(started) - epoch(due.due_at) < 120 then 'on time' else 'late' end as outcome
    from due left join a using (user_id, due_at) where true""")
def missed_runs_by_user(t):
    """Users as schedules due every six hours, their events as starts."""
    plans = t.events.select(F.col("user_id").alias("schedule_id"), F.lit("0 */6 * * *").alias("cron")).distinct()
    due = cron_due(plans, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30, 18))
    starts = t.events.select(F.col("user_id").alias("schedule_id"), F.col("ts").alias("started"))
    found = missed_runs(due, starts)
    return found.select("schedule_id", F.col("due_at").cast("string").alias("due_at"),
                        F.col("started").cast("string").alias("started"), "outcome")


@query("""with r as (select event_id, event_type, ts, ts + to_microseconds((round(value * 100) * 600000)::bigint) as finished from events),
    b as (select *, max(finished) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding)
                 as busy from r)
    select event_id, event_type, busy::varchar as busy_until from b where ts < busy""")
def overlapping_runs_by_type(t):
    """Events as runs of value minutes."""
    span = F.make_dt_interval(secs=(F.round(F.col("value") * 100).cast("decimal(18,0)") * F.lit(6) / F.lit(10)).cast("decimal(18,6)"))
    runs = t.events.select("event_id", "event_type", "ts", (F.col("ts") + span).alias("finished"))
    found = overlapping_runs(runs, "event_type", "event_id", "ts", "finished")
    return found.select("event_id", "event_type", F.col("busy_until").cast("string").alias("busy_until"))
