"""Queries of the SQL, join, set, window, sort and reshaping operators."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import scalars as X
from ..functions.readers import micros
from ..operators.python_code import map_batches, per_group
from ..operators.relational import (asof_join, attach, for_each_row, merge_lines, preview, range_join, route, route_rows,
                                    scrub)
from ..operators.ranges import range_totals, threshold_totals
from ..operators.sql import run_sql, transform
from ..operators.profile import finite_or_null
from ..sources.files import with_row_number
from ..sources.records import records_to_table, table_to_records
from .registry import query


def same_sql(name: str, sql: str, tables: list[str], params: dict | None = None, oracle: str | None = None):
    """A query that is one SQL text for both engines (with its parameters written in for the oracle)."""
    query(oracle or sql, name)(lambda t: run_sql(t.spark, sql, {n: getattr(t, n) for n in tables}, params))


same_sql("sql_params_in_list", """
    select event_type, user_id, count(*) as n, round(sum(value), 2) as total
    from events where event_type in (:kinds) and ts >= :since and event_type <> ':kinds' -- :note
    group by event_type, user_id having count(*) >= :least""", ["events"],
    {"kinds": ["purchase", "signup"], "since": dt.datetime(2024, 1, 10), "least": 2}, """
    select event_type, user_id, count(*) as n, round(sum(value), 2) as total
    from events where event_type in ('purchase', 'signup') and ts >= timestamp '2024-01-10'
    group by event_type, user_id having count(*) >= 2""")

same_sql("join_revenue_by_region", """
    select r_name as region, count(distinct c_custkey) as customers, count(*) as orders,
           round(sum(o_totalprice), 2) as revenue
    from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey
    join orders on o_custkey = c_custkey
    group by r_name""", ["region", "nation", "customer", "orders"])

same_sql("outer_joins", """
    select coalesce(c.nation, s.nation) as nation, c.customers, s.suppliers, n.n_name as name
    from (select c_nationkey as nation, count(*) as customers from customer where c_acctbal > 9000 group by c_nationkey) c
    full join (select s_nationkey as nation, count(*) as suppliers from supplier where s_acctbal < 3000
               group by s_nationkey) s on c.nation = s.nation
    left join nation n on n.n_nationkey = coalesce(c.nation, s.nation)""", ["customer", "supplier", "nation"])

same_sql("right_join", """
    select n_name as nation, count(s_suppkey) as suppliers
    from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name""",
    ["supplier", "nation"])

same_sql("semi_anti_customers", """
    select c_mktsegment as segment,
           count(*) filter (where has_orders) as with_orders, count(*) filter (where not has_orders) as without_orders
    from (select c_mktsegment, true as has_orders from customer
          where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)
          union all
          select c_mktsegment, false as has_orders from customer
          where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)) u
    group by c_mktsegment""", ["customer", "orders"])

@query("""select n_name as nation, count(*) as richer
          from (select n_name, avg(c_acctbal) as usual from customer join nation on c_nationkey = n_nationkey
                group by n_name) n
          join supplier on s_acctbal > usual group by n_name""")
def theta_join_sql(t):
    """(as counts over a threshold: the same rows as the join's, without its pairs)"""
    usual = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(
        F.avg("c_acctbal").alias("usual"))
    return threshold_totals(usual, t.supplier, "usual", ">", "s_acctbal", count="richer").where("richer > 0").select("nation", "richer")


@query("""select c_custkey, count(o_orderkey) as orders, cast(sum(o_totalprice) as decimal(38, 2)) as total,
                 count(o_orderkey) filter (where o_orderkey is not null) as same
          from customer left join orders on o_custkey = c_custkey and o_totalprice >= c_acctbal * 10 and o_totalprice <= c_acctbal * 40
          group by c_custkey""")
def range_totals_by_customer(t):
    """What each customer spent on orders of ten to forty times their balance: spans with equal keys, both ends in."""
    spans = t.customer.select("c_custkey", (F.col("c_acctbal") * 10).alias("low"), (F.col("c_acctbal") * 40).alias("high"))
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    made = range_totals(orders, spans, "o_totalprice", "low", "high", {"total": "price"}, "c_custkey", "both", count="orders")
    return made.select("c_custkey", "orders", "total", F.col("orders").alias("same"))


same_sql("using_join", """
    select l_orderkey, count(*) as lines, round(sum(l_extendedprice), 2) as price
    from lineitem join (select o_orderkey as l_orderkey from orders where o_orderstatus = 'F') o using (l_orderkey)
    group by l_orderkey""", ["lineitem", "orders"])

same_sql("setops_users", """
    select 'buyers or new' as what, user_id from
      (select user_id from events where event_type = 'purchase' and value > 150
       union select user_id from events where event_type = 'signup' and value > 150) a
    union all select 'both', user_id from
      (select user_id from events where event_type = 'purchase' and value > 150
       intersect select user_id from events where event_type = 'signup' and value > 150) b
    union all select 'buyers only', user_id from
      (select user_id from events where event_type = 'purchase' and value > 150
       except select user_id from events where event_type = 'signup' and value > 150) c""", ["events"])

same_sql("distinct_pairs", "select distinct user_id, event_type from events", ["events"])

same_sql("rollup_cube_sets", """
    select 'rollup' as how, l_returnflag, l_linestatus, count(*) as n, cast(sum(l_linenumber) as bigint) as numbers
    from lineitem group by rollup (l_returnflag, l_linestatus)
    union all select 'cube', l_returnflag, l_linestatus, count(*), cast(sum(l_linenumber) as bigint)
    from lineitem group by cube (l_returnflag, l_linestatus)
    union all select 'sets', l_returnflag, l_linestatus, count(*), cast(sum(l_linenumber) as bigint)
    from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""", ["lineitem"])

same_sql("window_sql", """
    select event_id, row_number() over w as place, rank() over v as by_value, dense_rank() over v as dense,
           ntile(4) over w as quarter, lag(event_type) over w as before, lead(event_type, 2) over w as after,
           round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 2)
             as recent
    from events
    window w as (partition by user_id order by ts, event_id), v as (partition by user_id order by value desc)""",
    ["events"])

same_sql("exact_sums", """
    select o_orderpriority as priority, cast(sum(o_orderkey * 9007199254) as bigint) as keys, count(*) as n
    from orders group by o_orderpriority""", ["orders"])

@query("""select n_nationkey as key, n_name, r_regionkey as key_1, r_name from nation join region
          on n_regionkey = r_regionkey""")
def duplicate_names_after_join(t):
    return run_sql(t.spark, """select n.*, r.* from (select n_nationkey as key, n_name, n_regionkey from nation) n
                               join (select r_regionkey as key, r_name from region) r on n.n_regionkey = r.key;""",
                   {"nation": t.nation, "region": t.region}).drop("n_regionkey")


@query("""select o_orderkey, o_totalprice * 1.2 as gross, upper(o_orderstatus) as status from orders
          where o_totalprice > 100000""")
def frame_transform(t):
    return transform(t.orders, lambda df, p: df.where(F.col("o_totalprice") > p["least"]).select(
        "o_orderkey", (F.col("o_totalprice") * 1.2).alias("gross"), F.upper("o_orderstatus").alias("status")),
        {"least": 100_000})


@query("""select e.event_id, e.user_id, (select max(c.ts) from events c where c.event_type = 'click'
                                         and c.user_id = e.user_id and c.ts <= e.ts) as click_ts,
                 (select arg_max(c.value, c.ts) from events c where c.event_type = 'click'
                  and c.user_id = e.user_id and c.ts <= e.ts) as click_value
          from events e where e.event_type = 'purchase'""")
def asof_last_event(t):
    clicks = t.events.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"), F.col("event_id").alias("click_id"))
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, clicks, "user_id", "ts", "click_ts", ["click_ts", "click_value"],
                     right_order=["click_id"]).drop("ts")


@query("""select x.event_id as error_id, count(*) as events, round(sum(e.value), 2) as total
          from events x join events e on e.ts >= x.ts and e.ts < x.ts + interval 1 hour
          where x.event_type = 'error' group by x.event_id""")
def range_join_error_hours(t):
    spans = t.events.where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.col("ts").alias("since"), (F.col("ts") + F.expr("interval 1 hour")).alias("till"))
    events = t.events.select("ts", F.col("value").cast("decimal(20,6)").alias("value"))
    made = range_totals(events, spans, "ts", "since", "till", {"total": "value"}, count="events")
    return made.select("error_id", "events", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("""select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) as row_number,
                 c_acctbal < 0 as owes from customer""")
def attach_by_row_number(t):
    numbered = with_row_number(t.customer.select("c_custkey", "c_acctbal"), "row_number", ["c_acctbal", "c_custkey"])
    return attach(numbered, numbered.select("row_number", (F.col("c_acctbal") < 0).alias("owes")), "row_number")


@query("select o_orderkey, o_orderkey + 1 as row_number from orders")
def row_numbers_of_file(t):
    return with_row_number(t.orders).select("o_orderkey", "row_number")


@query("""select r_regionkey + 1 as item_index, r_name, count(n_nationkey) as nations, min(n_name) as first_nation
          from region left join nation on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def lateral_per_item(t):
    return for_each_row(t.spark, t.region, """select count(*) as nations, min(n_name) as first_nation from nation
                                              where n_regionkey = item.r_regionkey;""",
                        {"nation": t.nation}, order_by=["r_regionkey"]).drop("r_regionkey")


@query("""select 'customers' as line, c_nationkey as nation, count(*) as n, null::bigint as others from customer
          group by c_nationkey
          union all select 'suppliers', s_nationkey, null, count(*) from supplier group by s_nationkey""")
def merged_lines(t):
    return merge_lines({
        "customers": t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")),
        "suppliers": t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("others"))})


@query("""select 'big' as way, count(*) as n from orders where nullif(o_orderpriority, '5-LOW') like '1%'
          union all select 'rest', count(*) from orders
          where not coalesce(nullif(o_orderpriority, '5-LOW') like '1%', false)
          union all select 'whole', count(*) from orders""")
def routed(t):
    yes, no = route_rows(t.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW"))), "p like '1%'")
    whole, _ = route(t.orders, "count(*) > 0")
    return merge_lines({"big": yes, "rest": no, "whole": whole}).groupBy(F.col("line").alias("way")).agg(F.count("*").alias("n"))


SECRETS = ["tion", "Nicht", "eaux", "de la", "heon's", "abc"]


@query("""select doc_id, md5(replace(replace(replace(replace(text, 'Nicht', '***'), 'de la', '***'), 'tion', '***'),
                                     'eaux', '***')) as scrubbed from documents""")
def scrub_text(t):
    return scrub(t.documents.select("doc_id", "text"), SECRETS).select("doc_id", F.md5("text").alias("scrubbed"))


@query("""select event_id, cast(props::json->>'k' as bigint) as k, event_type as kind from events
          union all select event_id, null, 'again' from events""")
def json_records(t):
    text = F.concat(F.lit("["), F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": "'), "event_type",
                    F.lit('"}, {"kind": "again"}]'))
    return records_to_table(t.events.select("event_id", text.alias("records")), "records", keep=["event_id"])


@query("""select to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'half': nullif(n_regionkey, 2)})::varchar as record
          from nation""")
def rows_to_json(t):
    return table_to_records(t.nation.select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(2)).alias("half")))


@query("""select event_type, count(*) as rows, count(*) filter (where value > 200) as dropped,
                 round(sum(value) filter (where value <= 200), 2) as total from events group by event_type""")
def null_out_nonfinite(t):
    spoiled = t.events.withColumn("value", F.when(F.col("value") > 300, float("inf")).when(
        F.col("value") > 200, float("nan")).otherwise(F.col("value")))
    clean = finite_or_null(spoiled, ["value"])
    return clean.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("dropped"),
                                           F.round(F.sum("value"), 2).alias("total"))


@query("""select * from (select o_orderkey, o_totalprice from orders order by o_orderkey limit 5)
          union all select * from (select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5)""")
def preview_ends(t):
    return preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("""select o_orderkey, cast(date_trunc('month', o_orderdate) as date)::varchar as month_start,
                 last_day(o_orderdate)::varchar as month_end, cast(date_trunc('week', o_orderdate) as date)::varchar as week_start,
                 cast(o_orderdate + interval 1 month as date)::varchar as next_month,
                 cast(o_orderdate - interval 14 day as date)::varchar as two_weeks_ago,
                 strftime(o_orderdate, '%d.%m.%Y') as written, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as day_key
          from orders""")
def date_functions(t):
    day = F.col("o_orderdate").cast("date")
    text = lambda c: c.cast("string")
    return t.orders.select(
        "o_orderkey", text(X.start_of_month(day)).alias("month_start"), text(X.end_of_month(day)).alias("month_end"),
        text(X.start_of_week(day)).alias("week_start"), text(X.shift_months(day, 1)).alias("next_month"),
        text(X.shift_weeks(day, -2)).alias("two_weeks_ago"), X.format_date(day, "%d.%m.%Y").alias("written"),
        X.truncated(X.format_date(day, "%Y%m%d")).alias("day_key"))


@query("""select c_custkey, cast(floor(c_acctbal / 7) as bigint) as floored,
                 round(c_acctbal - 7 * floor(c_acctbal / 7), 2) as rest, cast(trunc(c_acctbal) as bigint) as cut,
                 format('{:.1f}', c_acctbal)::double as even, format('{:,.2f}', c_acctbal) as cell,
                 case when c_acctbal < 0 then 'yes' else 'no' end as owes from customer""")
def number_functions(t):
    x = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", X.floor_div(x, F.lit(7)).alias("floored"), F.round(X.modulo(x, F.lit(7)), 2).alias("rest"),
        X.truncated(x).alias("cut"), X.rounded(x, 1).alias("even"), X.cell_text(x, T.DoubleType()).alias("cell"),
        X.cell_text(x < 0, T.BooleanType()).alias("owes"))


@query("""select l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice * 0.125)::double as eighth,
                 format('{:.0f}', l_quantity / 2)::double as half, (4611686018427387904 + l_orderkey) // l_linenumber as shared,
                 -((l_orderkey + l_linenumber - 1) // l_linenumber) as owed
          from lineitem""")
def exact_arithmetic(t):
    """Rounding on the binary value, and whole numbers beyond 2^53 divided as such."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", X.rounded(F.col("l_extendedprice") * 0.125, 2).alias("eighth"), X.rounded(F.col("l_quantity") / 2).alias("half"),
        X.floor_div(F.lit(2 ** 62) + key, line).alias("shared"), X.floor_div(-key, line).alias("owed"))


@query("""select p_partkey, p_size * 1024::double as bytes, p_size * 60::double as seconds, p_size as pieces,
                 strptime(p_size || '.01.2020', '%d.%m.%Y')::date::varchar as day
          from part where p_size <= 31
          union all select p_partkey, p_size * 1024::double, p_size * 60::double, p_size, null from part where p_size > 31""")
def written_forms(t):
    words = t.part.select("p_partkey", "p_size", F.concat("p_size", F.lit(" KB")).alias("size"), F.concat("p_size", F.lit("m")).alias("time"),
                          F.repeat(F.lit("a, "), F.col("p_size")).alias("list"),
                          F.when(F.col("p_size") <= 31, F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".01.2020"))).alias("day"))
    return words.select("p_partkey", X.size_bytes(F.col("size")).alias("bytes"), X.duration_seconds(F.col("time")).alias("seconds"),
                        F.size(X.split_list(F.col("list"))).alias("pieces"), X.parse_date(F.col("day"), "%d.%m.%Y").cast("string").alias("day"))


@query("""select event_type, count(*) as n, round(sum(value), 2) as total, round(max(value), 2) as largest from events
          group by event_type""")
def per_group_python(t):
    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [rows["event_type"].iloc[0]], "n": [len(rows)], "total": [rows["value"].sum()],
                             "largest": [rows["value"].max()]})

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby("event_type", as_index=False, dropna=False).agg({"n": "sum", "total": "sum", "largest": "max"})

    found = per_group(t.events.select("event_type", "value"), "event_type", partial, merge,
                      "event_type string, n bigint, total double, largest double")
    return found.withColumns({"total": F.round("total", 2), "largest": F.round("largest", 2)})


@query("select doc_id, length(text) as chars from documents")
def map_batches_python(t):
    return map_batches(t.documents.select("doc_id", "text"),
                       lambda rows: pd.DataFrame({"doc_id": rows["doc_id"], "chars": rows["text"].str.len()}),
                       "doc_id bigint, chars bigint")


@query("""select event_id, epoch_us(ts) as us, hour(ts)::int as hour, (isodow(ts) - 1)::int as weekday from events""")
def clock_parts(t):
    return t.events.select("event_id", micros(F.col("ts")).alias("us"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


@query("""select event_id, cast(ts - to_days(day(ts)::int - 1) as varchar) as month_start,
                 cast(ts + to_days(day(last_day(ts))::int - day(ts)::int) as varchar) as month_end,
                 cast(ts - to_days(isodow(ts)::int - 1) as varchar) as week_start,
                 cast(ts + interval 2 month as varchar) as in_two_months, cast(ts - interval 21 day as varchar) as three_weeks_ago
          from events""")
def shifted_times(t):
    """Shifts of timestamps keep the time of day."""
    ts, text = F.col("ts"), lambda c: c.cast("string")
    return t.events.select("event_id", text(X.start_of_month(ts)).alias("month_start"), text(X.end_of_month(ts)).alias("month_end"),
                           text(X.start_of_week(ts)).alias("week_start"), text(X.shift_months(ts, 2)).alias("in_two_months"),
                           text(X.shift_weeks(ts, -3)).alias("three_weeks_ago"))
