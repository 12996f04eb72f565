"""Queries of the table checks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.checks import (AllowedValues, ColumnTypes, Conditions, EarlierRun, Freshness, NoMissing, RowCount,
                                RowCountCompared, Unique, broken_rows, check_table, repeated_keys, unread_values)
from ..plans.lineage import checkpoint_dir
from ..plans.ranked import top_per_group
from .registry import query

# Orders with missing and unreadable values.
SPOILED = """(select o_orderkey, o_orderkey + 1 as row, nullif(o_orderpriority, '2-HIGH') as priority,
                     case when o_orderstatus = 'P' then '  ' else o_orderstatus end as status, o_custkey, o_totalprice,
                     case when o_totalprice > 450000 then 'N/A' when o_totalprice < 20000 then '1,' || o_custkey
                          else o_totalprice::varchar end as price_text,
                     case when o_orderdate >= timestamp '2001-01-01' then strftime(o_orderdate, '%Y-%-m-%-d')
                          else strftime(o_orderdate, '%Y-%m-%d') end as day_text, o_orderdate from orders)"""


def _spoiled(t) -> DataFrame:
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", (F.col("o_orderkey") + 1).alias("row"), F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("status"), "o_custkey", "o_totalprice",
        F.when(price > 450_000, "N/A").when(price < 20_000, F.concat(F.lit("1,"), "o_custkey"))
        .otherwise(price.cast("string")).alias("price_text"),
        F.when(day >= F.lit("2001-01-01").cast("timestamp_ntz"), F.date_format(day, "yyyy-M-d"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("day_text"), "o_orderdate")


def _checks() -> list:
    return [
        RowCount(at_least=1, at_most=10), RowCountCompared(earlier=EarlierRun(7, 100), if_fails="warn"),
        NoMissing(columns=["priority", "status", "o_custkey"], empty_text=True, allowed="25%"),
        Unique(columns=["o_custkey", "priority"]),
        ColumnTypes(types={"price_text": "float", "day_text": "date", "o_custkey": "float", "status": "text"}),
        AllowedValues(allowed={"price_text": "0..400000", "priority": "1-URGENT, 5-LOW", "day_text": "1995-06-01..",
                               "o_totalprice": "..480000.5", "o_orderdate": "1995-02-01..2001-06-01 00:00:00"}),
        Freshness(column="o_orderdate", at_least=dt.date(2001, 1, 1)),
        Conditions(rules=["o_totalprice >= 1000", "priority <> '3-MEDIUM'", "o_custkey > 0 or status = 'F'"]),
    ]


# The price as text where it reads as a number; a column per rule, true where a row breaks it.
_READ = "case when regexp_full_match(price_text, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then price_text::double end"
_DAY = "case when regexp_full_match(day_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(day_text as date) end"
RULES = {
    ("No missing values", "priority"): "priority is null", ("No missing values", "status"): "trim(status) = ''",
    ("Columns and types", "price_text"): f"({_READ}) is null", ("Columns and types", "day_text"): f"({_DAY}) is null",
    ("Values within a range or a list", "price_text"): f"(({_READ}) between 0 and 400000) is not true",
    ("Values within a range or a list", "priority"): "priority is not null and priority not in ('1-URGENT', '5-LOW')",
    ("Values within a range or a list", "day_text"): f"(({_DAY}) >= date '1995-06-01') is not true",
    ("Values within a range or a list", "o_totalprice"): "o_totalprice > 480000.5",
    ("Values within a range or a list", "o_orderdate"):
        "not (o_orderdate >= timestamp '1995-02-01' and o_orderdate <= timestamp '2001-06-01')",
    ("Conditions every row must meet", "o_totalprice >= 1000"): "(o_totalprice >= 1000) is not true",
    ("Conditions every row must meet", "priority <> '3-MEDIUM'"): "(priority <> '3-MEDIUM') is not true",
    ("Conditions every row must meet", "o_custkey > 0 or status = 'F'"): "(o_custkey > 0 or status = 'F') is not true",
}
_Q = chr(39)
BROKEN = " union all ".join(f"""select '{check}' as "check", '{rule.replace(_Q, _Q * 2)}' as rule, row from {SPOILED}
                                where {bad}""" for (check, rule), bad in RULES.items())


def _any(check: str, *names: str) -> str:
    return " or ".join(f"({bad})" for (c, r), bad in RULES.items() if c == check and (not names or r in names))


@query(f"""
    select 'Row count' as "check", 'failed' as outcome, null::bigint as rows
    union all select 'Row count compared with the last successful run', 'warned', null
    union all select 'No missing values', 'failed', count(*) from {SPOILED} where trim(status) = ''
    union all select 'Unique', 'failed', sum(n)::bigint from (select count(*) as n from {SPOILED} where priority is not null
                                                      group by o_custkey, priority having count(*) > 1)
    union all select 'Columns and types', 'failed', count(*) from {SPOILED} where {_any('Columns and types')}
    union all select 'Values within a range or a list', 'failed', count(*) from {SPOILED}
      where {_any('Values within a range or a list')}
    union all select 'Freshness', 'passed', null
    union all select 'Conditions every row must meet', 'failed', count(*) from {SPOILED}
      where {_any('Conditions every row must meet')}""")
def check_results(t):
    return check_table(_spoiled(t), _checks(), row="row").results.drop("details")


@query(f'select "check", rule, count(*) as rows, min(row) as first from ({BROKEN}) group by all')
def check_broken_rows(t):
    found = broken_rows(_spoiled(t), _checks(), row="row")
    return found.groupBy("check", "rule").agg(F.count("*").alias("rows"), F.min("row").alias("first"))


@query(f"""select "check", rule, row from ({BROKEN}) qualify row_number() over (partition by "check", rule order by row) <= 5""")
def check_examples(t):
    found = broken_rows(_spoiled(t), _checks(), row="row").select("check", "rule", "row")
    return top_per_group(found, ["check", "rule"], [F.asc("row")], 5).drop("rank")


@query(f"""with b as (select row from {SPOILED} where priority is null order by row limit 5),
                m as (select count(*) as n from {SPOILED} where priority is null)
           select 'priority has ' || format('{{:,}}', n) || ' gaps, 0 may be: ' ||
                  (select string_agg('row ' || format('{{:,}}', row) || ' (priority missing)', '; ' order by row) from b) as details
           from m""")
def check_details(t):
    found = check_table(_spoiled(t), [NoMissing(columns=["priority", "o_custkey"])], row="row")
    return found.results.select("details")


@query(f"""select price_text as "value", count(*) as rows, min(row) as first from {SPOILED} where ({_READ}) is null
           group by 1 order by rows desc, first limit 5""")
def unreadable_values(t):
    return unread_values(_spoiled(t), "price_text", "float", row="row")


@query(f"""select day_text as "value", count(*) as rows, min(row) as first from {SPOILED} where ({_DAY}) is null group by 1""")
def unreadable_dates_all(t):
    return unread_values(_spoiled(t), "day_text", "date", row="row", k=None)


@query(f"""select o_custkey, priority, count(*) as rows, min(row) as first from {SPOILED} where priority is not null
           group by 1, 2 having count(*) > 1 order by first limit 5""")
def repeated_key_examples(t):
    return repeated_keys(_spoiled(t), ["o_custkey", "priority"], row="row")


FILE_ROWS = 500_000


def in_files(t, folder: str):
    """The orders in order, written as files of unlike sizes in three folders, and read back."""
    made = f"{checkpoint_dir(t.spark)}/{folder}-{uuid.uuid4().hex}"
    last, rows = t.orders.agg(F.max("o_orderkey"), F.count("*")).first()
    files = max(2, rows // FILE_ROWS)  # (of a folder; each is put in order by one task)
    ends = [0, last // 50, last - last // 10, last + 1]
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        part = t.orders.where(F.col("o_orderkey").between(a, b - 1)).repartitionByRange(files, "o_orderkey")
        part.sortWithinPartitions("o_orderkey").write.parquet(f"{made}/{i}")
    return t.spark.read.parquet(*[f"{made}/{i}" for i in range(3)])


@query("""select o_custkey, count(*) as rows, min(o_orderkey) + 1 as first from orders group by o_custkey having count(*) > 1""")
def repeated_keys_over_files(t):
    """Rows are named by their true numbers in a table of several files."""
    return repeated_keys(in_files(t, "orders"), ["o_custkey"], k=None)


@query("""select o_orderpriority as "value", count(*) as rows, min(n) as first
          from (select o_orderpriority, row_number() over (order by o_orderkey) as n from orders where o_totalprice > 100000)
          where o_orderpriority <> '1-URGENT' group by 1""")
def unread_values_of_some_rows(t):
    """Rows of a filtered table are numbered among themselves."""
    some = in_files(t, "some").where("o_totalprice > 100000").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise(F.col("o_orderpriority")))
    return unread_values(some, "o_orderpriority", "int", k=None)
