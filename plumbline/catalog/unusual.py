"""Queries of the anomaly detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.anomalies import detect_anomalies
from .registry import ORACLE, query
from .table_checks import in_files

# What a point is judged by, from `p` (s: series, block, whole, row, v): its history, expected value and range.
_JUDGED = """
    h as (select p.*, coalesce((select list(q.v order by q.whole, q.row) from p q where q.s is not distinct from p.s
                                and q.block = p.block and q.whole < p.whole and q.v is not null)[-{last}:], []) as past from p),
    m as (select *, case when len(past) >= 4 then list_aggregate(past, 'median') end as mid from h),
    d as (select *, list_transform(past, lambda x: abs(x - mid)) as apart from m),
    j as (select *, mid as expected, case when list_aggregate(apart, 'median') > 0 then 1.4826 * list_aggregate(apart, 'median')
                                     when mid is not null then 1.2533 * list_aggregate(apart, 'avg') end as spread from d),
    r as (select *, expected - {k} * spread as low, expected + {k} * spread as high from j)"""


def _judged(points: str, last: int = 8, k: int = 3) -> str:
    return f"with {points}, " + _JUDGED.format(last=last, k=k)


_N = "regexp_replace(format('{{:,.2f}}', {0}), '\\.?0+$', '')"
_WEEKDAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"


def _n(x: str) -> str:
    return _N.format(x)


def _daily(t) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


DAILY = """select o_orderdate::date as day, o_orderpriority as s, isodow(o_orderdate) - 1 as block,
                  (epoch(o_orderdate::date) // 86400)::bigint as whole, 0 as row, count(*)::double as v, sum(o_totalprice) as total
           from orders group by all"""


@query(_judged(f"p as ({DAILY})") + f""", w as (select *, ({_WEEKDAYS})[block + 1] as name from r)
    select day::varchar as day, s as priority, round(expected, 8) as expected, round(low, 8) as low, round(high, 8) as high,
           coalesce(len(past) >= 4 and (v < low or v > high), false) as anomaly,
           left(name, 3) || ' ' || day || ', ' || s || ': ' || case
             when len(past) < 4 then 'n: not enough history: ' || len(past) || ' earlier ' || name || 's, 4 needed'
             when (v < low or v > high) and spread = 0 then
               'n ' || {_n('v')} || '; the ' || len(past) || ' earlier ' || name || 's were all ' || {_n('expected')}
             when v < low or v > high then 'n ' || {_n('v')} || '; a usual ' || name || ' is ' || {_n('expected')} || ' (' ||
               {_n('low')} || '–' || {_n('high')} || ')'
             else 'n ' || {_n('v')} || '; within the usual range of a ' || name || ': ' || {_n('expected')} || ' (' ||
               {_n('low')} || '–' || {_n('high')} || ')' end as reason
    from w""")
def anomaly_weekday(t):
    found = detect_anomalies(_daily(t), "day", ["n"], ["priority"], only_latest=False).table
    return found.select(F.col("day").cast("string").alias("day"), "priority", F.round("n_expected", 8).alias("expected"),
                        F.round("n_low", 8).alias("low"), F.round("n_high", 8).alias("high"), "anomaly", "reason")



@query(f"""with base as ({DAILY}), one as (select * from ({_judged('p as (select * from base)', 6, 2)} select * from r)),
                two as (select * from ({_judged('p as (select * replace (nullif(round(total), 0) as v) from base)', 6, 2)} select * from r))
           select one.day::varchar as day, one.s as priority, round(one.high, 8) as n_high, round(two.high, 6) as total_high,
                  coalesce(len(one.past) >= 4 and (one.v < one.low or one.v > one.high), false)
                    or coalesce(len(two.past) >= 4 and (two.v < two.low or two.v > two.high), false) as anomaly
           from one join two on one.day = two.day and one.s = two.s""")
def anomaly_two_numbers(t):
    daily = _daily(t).withColumn("total", F.round("total"))
    found = detect_anomalies(daily, "day", ["n", "total"], ["priority"], last=6, sensitivity="high", only_latest=False).table
    return found.select(F.col("day").cast("string").alias("day"), "priority", F.round("n_high", 8).alias("n_high"),
                        F.round("total_high", 6).alias("total_high"), "anomaly")


HOURLY = """select date_trunc('hour', ts) as hour, event_type as s, hour(ts) as block, epoch(date_trunc('hour', ts)) // 3600 as whole,
                   0 as row, nullif(count(*), 2)::double as v from events group by all"""


@query(_judged(f"p as ({HOURLY})", 12, 4) + """
    select hour::varchar as hour, s as kind, round(expected, 8) as expected, round(low, 8) as low, round(high, 8) as high,
           case when v is not null then coalesce(len(past) >= 4 and (v < low or v > high), false) end as anomaly from r""")
def anomaly_hour(t):
    """Counts per hour, those of 2 missing."""
    hourly = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("kind")).agg(
        F.nullif(F.count("*"), F.lit(2)).alias("n"))
    found = detect_anomalies(hourly, "hour", ["n"], ["kind"], pattern="hour of day", last=12, sensitivity="low",
                             only_latest=False).table
    return found.select(F.col("hour").cast("string").alias("hour"), "kind", F.round("n_expected", 8).alias("expected"),
                        F.round("n_low", 8).alias("low"), F.round("n_high", 8).alias("high"), "anomaly")


@query(_judged("""p as (select o_orderkey, null as s, 0 as block, epoch(o_orderdate::date) // 86400 as whole, o_orderkey as row,
                               nullif(o_totalprice, 0) as v from orders)""") + """
    select o_orderkey, round(expected, 8) as expected, round(low, 8) as low,
           coalesce(len(past) >= 4 and (v < low or v > high), false) as anomaly from r""")
def anomaly_none(t):
    """Every order against the 8 orders before its day: many rows per date, one series."""
    dated = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    found = detect_anomalies(dated, "day", ["o_totalprice"], pattern="none", only_latest=False, row="o_orderkey").table
    return found.select("o_orderkey", F.round("o_totalprice_expected", 8).alias("expected"),
                        F.round("o_totalprice_low", 8).alias("low"), "anomaly")


# Series of raw times, compared in the unit their median gap gives.
RAW = """g as (select event_type as s, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts) as gap
              from (select distinct event_type, ts from events)),
         med as (select s, median(gap) as m from g group by s),
         u as (select s, case when round_even(m / 3600000000, 0) * 3600000000 >= 86400000000 then 86400000000
                              when round_even(m / 60000000, 0) * 60000000 >= 3600000000 then 3600000000
                              when round_even(m / 1000000, 0) * 1000000 >= 60000000 then 60000000 else 1000000 end as unit
               from med),
         p as (select event_id, event_type as s, hour(ts) as block, epoch_us(ts) // unit as whole, event_id as row, value as v, unit
               from events join u on s = event_type)"""


@query(_judged(RAW) + """
    select event_id, round(expected, 8) as expected, round(high, 8) as high,
           coalesce(len(past) >= 4 and (v < low or v > high), false) as anomaly from r""")
def anomaly_raw_times(t):
    found = detect_anomalies(t.events, "ts", ["value"], ["event_type"], pattern="hour of day", only_latest=False,
                             row="event_id").table
    return found.select("event_id", F.round("value_expected", 8).alias("expected"), F.round("value_high", 8).alias("high"), "anomaly")


@query(_judged(f"p as ({DAILY})") + """
    select s as series, 'n' as number, count(*) as judged, count(*) filter (where len(past) >= 4 and (v < low or v > high)) as unusual,
           count(*) filter (where len(past) < 4) as few_history, 0::bigint as missing from r group by s""")
def anomaly_summary(t):
    return detect_anomalies(_daily(t), "day", ["n"], ["priority"], only_latest=False).summary


@query(_judged(f"p as ({DAILY})") + """
    select s as priority, day::varchar as day, round(expected, 8) as expected,
           coalesce(len(past) >= 4 and (v < low or v > high), false) as anomaly
    from r where day = (select max(o_orderdate::date) from orders)""")
def anomaly_latest_only(t):
    found = detect_anomalies(_daily(t), "day", ["n"], ["priority"]).table.where("anomaly IS NOT NULL")
    return found.select("priority", F.col("day").cast("string").alias("day"), F.round("n_expected", 8).alias("expected"), "anomaly")


# The dates a series misses at its usual step, by the definition.
GAPS = f"""p as ({DAILY}), g as (select s, whole, whole - lag(whole) over (partition by s order by whole) as gap from p),
    n as (select s, count(gap) as n, min(whole) as lo, max(whole) as hi, median(gap) as mid from g group by s),
    st as (select s, gap as step, count(*) as times from g where gap is not null group by s, gap
           qualify row_number() over (partition by s order by times desc, gap) = 1),
    ok as (select n.s, lo, hi, step, case when mid >= 28 then 'a month or more apart'
             when 2 * times < n.n then 'no regular step' end as why from n join st using (s)),
    e as (select s, step, unnest(range(lo, hi + 1, step)) as whole from ok where why is null),
    m as (select e.s, e.whole, date '1970-01-01' + e.whole::int as day, step || case when step = 1 then ' day' else ' days' end as step
          from e anti join p on p.s = e.s and p.whole = e.whole
          where exists (select 1 from p where p.s = e.s and (p.whole + 3) % 7 = (e.whole + 3) % 7))"""


@query(f"with {GAPS} select s as series, day::date::varchar as date, step from m")
def series_gaps(t):
    return detect_anomalies(_daily(t), "day", ["n"], ["priority"]).missing_dates.select("series", "date", "step")


@query(f"""with {GAPS}, k as (select *, row_number() over (partition by s order by whole) as k from m)
           select s as series, step, count(*) as missing, string_agg(day::date::varchar, ', ' order by whole) filter (where k <= 5)
                  as first_dates, null::varchar as not_checked from k group by s, step
           union all select s, null, null, null, why from ok where why is not null""")
def series_gap_warnings(t):
    return detect_anomalies(_daily(t), "day", ["n"], ["priority"]).gaps


@query("""with d as (select o_orderpriority as s, o_orderdate::date as day, count(*) as n from orders group by all having count(*) > 1),
               r as (select *, row_number() over (partition by s order by day) as k from d)
          select s as series, count(*) as dates, sum(n)::bigint as rows,
                 string_agg(day::varchar, ', ' order by day) filter (where k <= 5) as first_dates from r group by s""")
def series_duplicates(t):
    dated = t.orders.select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return detect_anomalies(dated, "day", ["o_totalprice"], ["o_orderpriority"]).repeated_dates


@query("""select o_custkey::varchar as series, max(o_orderdate)::date::varchar as latest,
                 (select max(o_orderdate)::date::varchar from orders) as table_latest from orders group by o_custkey
          having max(o_orderdate) <> (select max(o_orderdate) from orders)""")
def series_behind(t):
    dated = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return detect_anomalies(dated, "day", ["o_totalprice"], ["o_custkey"]).behind


@query("""select o_orderpriority as series, count(distinct o_orderdate) as points from orders group by 1""")
def anomaly_chart_points(t):
    found = detect_anomalies(_daily(t), "day", ["n"], ["priority"]).chart_data("n")
    return found.groupBy("series").agg(F.count("*").alias("points"))


@query(ORACLE["anomaly_none"])
def anomaly_none_over_files(t):
    """The same as anomaly_none, the order being that of the rows in files of unlike sizes."""
    orders = in_files(t, "dated")
    dated = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    found = detect_anomalies(dated, "day", ["o_totalprice"], pattern="none", only_latest=False).table
    return found.select("o_orderkey", F.round("o_totalprice_expected", 8).alias("expected"),
                        F.round("o_totalprice_low", 8).alias("low"), "anomaly")


@query("""
    with p as (select o_orderkey, pos, o_orderdate::date as day, isodow(o_orderdate) as block, o_orderkey * 2 + pos as row,
                      [o_totalprice, o_totalprice / 2][pos] as v from orders, (values (1), (2)) as two(pos)),
    days as (select block, day, list(v order by row) as h from p group by all),
    past as (select block, day, flatten(coalesce(list(h) over (partition by block order by day rows between 8 preceding and 1 preceding), []))[-8:] as past
             from days)
    select o_orderkey, pos::int as pos, round(case when len(past) >= 4 then list_aggregate(past, 'median') end, 6) as expected
    from p join past using (block, day)""")
def anomaly_exploded_rows(t):
    """Two rows made of each row of the files: a busy date's latest values are those that come last among the made rows."""
    both = F.posexplode(F.array("o_totalprice", F.col("o_totalprice") / 2)).alias("pos", "v")
    made = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), both).withColumn("pos", F.col("pos") + 1)
    found = detect_anomalies(made, "day", ["v"], only_latest=False).table
    return found.select("o_orderkey", "pos", F.round("v_expected", 6).alias("expected"))
