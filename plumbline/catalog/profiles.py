"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import col
from ..operators import profile as P
from .registry import query

NUMBERS = ["count", "missing", "missing %", "distinct", "mean", "std", "min", "25%", "median", "75%", "max", "sum", "zeros",
           "negatives"]


def _number_sql(source: str, columns: list[str], groups: str = "") -> str:
    """The statistics of number columns, a SELECT per column."""
    by, keys = (f" group by {groups}", f"{groups}, ") if groups else ("", "")
    return " union all ".join(f"""
        select {keys}'{c}' as "column", count({c}) as "count", count(*) - count({c}) as missing,
               round(100.0 * (count(*) - count({c})) / count(*)::double, 4) as "missing %", count(distinct {c}) as "distinct",
               round(avg({c}::double), 4) as mean, round(stddev_samp({c}::double), 4) as std,
               round(min({c})::double, 4) as "min", round(quantile_cont({c}::double, 0.25), 4) as "25%",
               round(quantile_cont({c}::double, 0.5), 4) as "median", round(quantile_cont({c}::double, 0.75), 4) as "75%",
               round(max({c})::double, 4) as "max", round(sum({c})::double, 2) as "sum",
               count(*) filter (where {c} = 0) as zeros, count(*) filter (where {c} < 0) as negatives
        from {source}{by}""" for c in columns)


def _rounded(stats: DataFrame, keep=()) -> DataFrame:
    places = {"sum": 2, "mean": 4, "std": 4, "min": 4, "max": 4, "25%": 4, "median": 4, "75%": 4, "missing %": 4}
    return stats.select(*keep, "column", *[F.round(col(s).cast("double"), places[s]).alias(s) if s in places else col(s)
                                          for s in NUMBERS])


LINES = "(select l_orderkey, l_linenumber, nullif(l_quantity, 7.0) as l_quantity, l_extendedprice, l_discount, l_tax from lineitem)"
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(t) -> DataFrame:
    return t.lineitem.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0))).select(*LINE_COLUMNS)


@query(_number_sql(LINES, LINE_COLUMNS))
def profile_lineitem(t):
    return _rounded(P.profile(_lines(t), parts=("numbers",)).stats)


@query(_number_sql(LINES, LINE_COLUMNS))
def profile_lineitem_in_passes(t):
    """The same of columns given by name."""
    return _rounded(P.profile(t.lineitem.withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0))), LINE_COLUMNS, parts=("numbers",)).stats)


ORDERS = """(select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as priority,
                    nullif(o_orderstatus, 'P') as status, o_custkey, o_totalprice, o_orderdate from orders)"""


def _orders(t) -> DataFrame:
    return t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                           F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_custkey", "o_totalprice", "o_orderdate")


@query(_number_sql(ORDERS, ["o_custkey", "o_totalprice"], "priority"))
def profile_orders_by_priority(t):
    found = P.profile(_orders(t), ["o_custkey", "o_totalprice"], ["priority"], parts=("numbers",))
    return _rounded(found.stats, ["priority"])


@query(_number_sql(ORDERS, ["o_custkey", "o_totalprice"], "priority, status"))
def profile_two_groups_in_passes(t):
    found = P.profile(_orders(t), ["o_custkey", "o_totalprice"], ["priority", "status"], parts=("numbers",))
    return _rounded(found.stats, ["priority", "status"])


@query(f"""with v as (select priority, status as v, count(*) as n from {ORDERS} where status is not null group by all),
                r as (select *, row_number() over (partition by priority order by n desc, v) as k from v)
           select o.priority, 'status' as "column", 'string' as type, count(status) as "count", count(*) - count(status) as missing,
                  count(distinct status) as "distinct", min(status) as "min", max(status) as "max",
                  min(length(status)) as shortest, max(length(status)) as longest,
                  (select string_agg(v || ' (' || format('{{:,}}', n) || ')', ', ' order by k) from r
                   where r.priority is not distinct from o.priority and k <= 5) as "most common"
           from {ORDERS} o group by o.priority""")
def profile_text_by_priority(t):
    found = P.profile(_orders(t), ["status"], ["priority"], parts=("text",)).stats
    return found.select("priority", "column", "type", "count", "missing", "distinct", "min", "max", "shortest", "longest",
                        "most common")


@query("""select 'ts' as "column", 'timestamp_ntz' as type, count(ts) as "count", count(distinct ts) as "distinct",
                 min(ts)::varchar as "first", max(ts)::varchar as "last" from events
          union all select 'event_type', 'string', count(event_type), count(distinct event_type), null, null from events""")
def profile_dates(t):
    return P.profile(t.events, ["ts", "event_type"], parts=("dates",)).stats.select(
        "column", "type", "count", "distinct", "first", "last")


@query("""select 'l_suppkey' as "column", 'distinct, 25%, median, 75%' as estimated, true as distinct_near, true as median_near
          union all select 'l_extendedprice', 'distinct, 25%, median, 75%', true, true""")
def profile_estimated(t):
    """Estimates against the table: distinct within 15 %, the median with half the rows, give or take 1 %, either side."""
    columns = ["l_suppkey", "l_extendedprice"]
    lines = t.lineitem.select(*columns)
    guessed = {r["column"]: r for r in P.profile(lines, parts=("numbers",), exact=False).stats.collect()}
    told = []
    for c in columns:
        r, half = guessed[c], F.count("*") / 2
        slack = half * 0.02
        told.append(F.struct(
            F.lit(c).alias("column"), F.lit(r["estimated"]).alias("estimated"),
            (F.abs(F.count_distinct(c) - r["distinct"]) <= 0.15 * F.count_distinct(c)).alias("distinct_near"),
            ((F.count_if(F.col(c) < r["median"]) <= half + slack) & (F.count_if(F.col(c) <= r["median"]) >= half - slack))
            .alias("median_near")))
    return lines.agg(F.array(*told).alias("told")).select(F.inline("told"))


@query("""select o_orderpriority as priority, round(quantile_cont(o_totalprice, 0.95), 4) as p95,
                 round(avg(case when o_orderstatus = 'F' then 1 else 0 end), 6) as done_share,
                 count(*) filter (where o_totalprice > 400000) as big_orders, count(distinct o_custkey) as customers
          from orders group by o_orderpriority""")
def profile_custom(t):
    found = P.custom_statistics(t.orders, {
        "p95": "quantile_cont(o_totalprice, 0.95)", "done_share": "avg(case when o_orderstatus = 'F' then 1 else 0 end)",
        "big_orders": "count_if(o_totalprice > 400000)", "customers": "count(distinct o_custkey)"}, ["o_orderpriority"])
    return found.select(F.col("o_orderpriority").alias("priority"), F.round("p95", 4).alias("p95"),
                        F.round("done_share", 6).alias("done_share"), "big_orders", "customers")


@query("""select l_returnflag as flag, round(quantile_cont(l_extendedprice * (1 - l_discount), 0.9), 4) as p90, count(*) as n
          from lineitem group by 1""")
def profile_custom_in_passes(t):
    found = P.custom_statistics(t.lineitem, {"p90": "quantile_cont(l_extendedprice * (1 - l_discount), 0.9)", "n": "count(*)"},
                                ["l_returnflag"])
    return found.select(F.col("l_returnflag").alias("flag"), F.round("p90", 4).alias("p90"), "n")


CLOSE = """(select 1000000000000000 + l_orderkey * 8 + l_linenumber as id, 1704067200000000 + (l_partkey * 7919 + l_suppkey) % 60000000 as moment,
                   1e300 * l_tax as huge, 1e-300 * l_discount as tiny, cast(l_extendedprice as decimal(12, 2)) as price from lineitem)"""


@query(" union all ".join(f"""select '{c}' as "column", count(distinct {c}) as "distinct", quantile_cont({c}::double, 0.25) as "25%",
                                     quantile_cont({c}::double, 0.5) as "median", quantile_cont({c}::double, 0.75) as "75%" from {CLOSE}"""
                          for c in ("id", "moment", "huge", "tiny", "price")))
def profile_close_numbers(t):
    """Numbers that are alike in most of their digits, and of every size: ids from 10^15, moments of one minute."""
    lines = t.lineitem.selectExpr("1000000000000000 + l_orderkey * 8 + l_linenumber as id", "1704067200000000 + (l_partkey * 7919 + l_suppkey) % 60000000 as moment",
                                  "1e300D * l_tax as huge", "1e-300D * l_discount as tiny", "cast(l_extendedprice as decimal(12, 2)) as price")
    return P.profile(lines, parts=("numbers",)).stats.select("column", "distinct", "25%", "median", "75%")


@query("""select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as spread,
                 round(sum(l_extendedprice) / quantile_cont(l_extendedprice, 0.5), 4) as medians_worth,
                 quantile_cont(l_quantity, 0.5) filter (where l_tax > 0.04) as taxed_quantity, count(*) as n,
                 case when quantile_cont(l_quantity, 0.5) > 25 then 'many' else 'few' end as told
          from lineitem group by 1""")
def profile_custom_expressions(t):
    """Percentiles inside larger expressions, with a filter, and beside other aggregates."""
    found = P.custom_statistics(t.lineitem, {
        "spread": "round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4)",
        "medians_worth": "round(sum(l_extendedprice) / percentile(l_extendedprice, 0.5), 4)",
        "taxed_quantity": "quantile_cont(l_quantity, 0.5) filter (where l_tax > 0.04)", "n": "count(*)",
        "told": "case when quantile_cont(l_quantity, 0.5) > 25 then 'many' else 'few' end"}, ["l_returnflag"])
    return found.withColumnRenamed("l_returnflag", "flag")


def _corr_sql(columns: list[str], source: str, groups: str = "") -> str:
    keys, by = (f"{groups}, ", f" group by {groups}") if groups else ("", "")
    return " union all ".join(f"select {keys}'{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 6) as r from {source}{by}"
                              for i, a in enumerate(columns) for b in columns[i + 1:])


@query(_corr_sql(["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"], LINES))
def correlations_lineitem(t):
    found = P.correlations(_lines(t), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return found.select("a", "b", F.round("r", 6).alias("r"))


@query(_corr_sql(["o_custkey", "o_totalprice"], ORDERS, "priority"))
def correlations_by_priority(t):
    found = P.correlations(_orders(t), ["o_custkey", "o_totalprice"], ["priority"])
    return found.select("priority", "a", "b", F.round("r", 6).alias("r"))


@query("""with b as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 20 as w from orders),
               c as (select least(floor((o_totalprice - lo) / w)::int, 19) as bin, count(*) as rows from orders, b group by 1)
          select 'o_totalprice' as "column", i::int as bin, round(lo + i * w, 4) as low, round(lo + (i + 1) * w, 4) as high,
                 coalesce(rows, 0) as rows
          from b, generate_series(0, 19) s(i) left join c on c.bin = i""")
def histogram_totalprice(t):
    return P.histograms(t.orders, ["o_totalprice"]).select(
        "column", "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "rows")


@query("""select 'l_linenumber' as "column", (l_linenumber - 1)::int as bin, l_linenumber - 0.5::double as low,
                 l_linenumber + 0.5::double as high, count(*) as rows from lineitem group by l_linenumber""")
def histogram_small_ints(t):
    return P.histograms(t.lineitem, ["l_linenumber"])


@query("""select date_trunc('month', o_orderdate)::date::varchar as period, 'month' as unit, count(*) as rows
          from orders group by 1""")
def rows_over_time(t):
    found = P.rows_over_time(t.orders, "o_orderdate")
    return found.select(F.col("period").cast("string").alias("period"), "unit", "rows")


@query("""select ts::date::varchar as period, 'day' as unit, count(*) as rows from events group by 1""")
def rows_per_day(t):
    found = P.rows_over_time(t.events, "ts")
    return found.select(F.col("period").cast("string").alias("period"), "unit", "rows")


@query("""select o_orderpriority as priority, o_custkey as value, count(*) as rows,
                 row_number() over (partition by o_orderpriority order by count(*) desc, o_custkey)::int as rank
          from orders group by 1, 2 qualify rank <= 5""")
def top_values_by_group(t):
    return P.top_values(t.orders, "o_custkey", 5, ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "priority")


@query("""select case when length(text) > 40 then left(text, 39) || '…' else text end as value, n as rows,
                 (select count(distinct text) from conversations) as of_distinct
          from (select text, count(*) as n from conversations group by text order by n desc, text limit 10)""")
def top_values_chart(t):
    return P.profile(t.conversations, ["text"]).top_values("text")


@query("""select l_returnflag || ' · ' || l_linestatus as "group", count(*) as rows from lineitem
          group by l_returnflag, l_linestatus order by rows desc, 1 limit 10""")
def largest_groups(t):
    return P.rows_per_group(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("""select count(*) - (select count(*) from (select distinct l_quantity, l_discount, l_tax, l_returnflag from lineitem))
          as repeated_rows from lineitem""")
def repeated_rows(t):
    return P.profile(t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag")).repeated_rows


@query(f"""select count(*) as rows, 5 as columns, count(*) * 5 as cells,
                  (count(*) - count(priority)) + (count(*) - count(status)) as missing_cells,
                  round(100.0::double * ((count(*) - count(priority)) + (count(*) - count(status))) / (count(*) * 5), 4)
                    as missing_percent,
                  count(*) - (select count(*) from (select distinct * from {ORDERS})) as repeated_rows
           from {ORDERS}""")
def overview(t):
    return P.profile(_orders(t)).overview.withColumn("missing_percent", F.round("missing_percent", 4))


@query(f"""select 'priority' as "column", 'string' as type, count(*) - count(priority) as missing from {ORDERS}
           union all select 'status', 'string', count(*) - count(status) from {ORDERS}
""")
def overview_columns(t):
    return P.profile(_orders(t)).overview_columns.where("missing > 0").drop("missing_percent")


@query("""select o_orderpriority as priority, 'count' as statistic, count(o_custkey)::varchar as value from orders group by 1
          union all select o_orderpriority, 'distinct', count(distinct o_custkey)::varchar from orders group by 1
          union all select o_orderpriority, 'missing', '0' from orders group by 1
          union all select o_orderpriority, 'missing %', '0.0' from orders group by 1
          union all select o_orderpriority, 'min', min(o_custkey)::varchar from orders group by 1
          union all select o_orderpriority, 'max', max(o_custkey)::varchar from orders group by 1""")
def statistics_long(t):
    stats = P.profile(t.orders, ["o_custkey"], ["o_orderpriority"], parts=()).stats
    return P.long_statistics(stats).select(F.col("o_orderpriority").alias("priority"), "statistic", "value")


@query("""select o_orderpriority as priority, count(o_custkey)::varchar as "count", max(o_custkey)::varchar as "max" from orders
          group by 1""")
def statistics_wide_again(t):
    long = P.long_statistics(P.profile(t.orders, ["o_custkey"], ["o_orderpriority"], parts=()).stats)
    return P.wide_statistics(long, ["count", "max"]).select(F.col("o_orderpriority").alias("priority"), "count", "max")
