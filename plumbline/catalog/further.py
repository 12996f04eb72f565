"""Queries of orders of rows, first rows, written and read forms, your own Python, file listings and unusual durations."""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid

from pyspark.sql import DataFrame, functions as F

from ..errors import OperatorError
from ..functions import scalars as X
from ..functions.params import render_path
from ..operators import profile as P
from ..operators.anomalies import detect_anomalies
from ..operators.file_checks import check_files
from ..operators.ledger import step_durations
from ..operators.python_code import Step, in_order, run_python
from ..operators.relational import chart_points, head, showing
from ..operators.sketches import estimates, sketch
from ..operators.sql import run_sql
from ..plans.lineage import checkpoint_dir
from ..sources.files import as_table, list_files, read_table, write_table
from ..sources.jdbc import normalise_jdbc_types
from .history import RUNS, _runs, _steps
from .registry import query


def _scratch(t, name: str) -> str:
    return posixpath.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def _places(df: DataFrame) -> DataFrame:
    """The rows of a table cut to its first ones, which are in one partition, with their place from 1."""
    return df.withColumn("place", F.monotonically_increasing_id() + 1)


@query("""select row_number() over (order by o_totalprice desc, o_orderkey) as place, o_orderkey from orders
          qualify place <= 100""")
def order_by_places(t):
    return _places(run_sql(t.spark, "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 100", {"orders": t.orders}))


@query("""select row_number() over (order by balance nulls last, c_custkey) as place, c_custkey, balance
          from (select c_custkey, nullif(greatest(c_acctbal, 9000), 9000) as balance from customer) qualify place <= 200""")
def nulls_last_places(t):
    customers = t.customer.select("c_custkey", F.nullif(F.greatest("c_acctbal", F.lit(9000.0)), F.lit(9000.0)).alias("balance"))
    return _places(run_sql(t.spark, "select c_custkey, balance from c order by balance nulls last, c_custkey limit 200", {"c": customers}))


@query("""select 'showing' as what, 7 as rows, 'Showing 7 of ' || format('{:,}', count(*)) || ' rows.' as told from orders
          union all select 'all', count(*), '' from region
          union all select 'chart', least(5000, count(*)), case when count(*) > 5000 then
                      'charting the first 5,000 of ' || format('{:,}', count(*)) || ' rows' else '' end from lineitem
          union all select 'head', 3, '' from (select 1)
          union all select 'extra', least(100, count(*)), 'the first ' || least(100, count(*)) || ' of ' || count(*) from customer""")
def first_rows_told(t):
    found = []
    for what, (rows, told) in {"showing": showing(t.orders, 7), "all": showing(t.region, 9), "chart": chart_points(t.lineitem), "head": (head(t.orders, 3), "")}.items():
        found.append(rows.agg(F.lit(what).alias("what"), F.count("*").alias("rows"), F.lit(told).alias("told")))
    rows, total = P.first_rows(t.customer)
    found.append(rows.agg(F.lit("extra").alias("what"), F.count("*").alias("rows"), F.concat(F.lit("the first "), F.count("*"), F.lit(f" of {total}")).alias("told")))
    made = found[0]
    for one in found[1:]:
        made = made.unionByName(one)
    return made


@query("""select 'clean' as what, 'finite' as told
          union all select 'spoiled', 'l_tax (' || format('{:,}', count(*) filter (where l_linenumber = 1)) || ' NaN, ' ||
            format('{:,}', count(*) filter (where l_linenumber = 2)) || ' infinite)' from lineitem""")
def nonfinite_refused(t):
    """What a failed assertion says of the values it names."""
    bad = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("-inf")).otherwise(F.col("l_tax"))
    told = []
    for what, table in (("clean", t.lineitem), ("spoiled", t.lineitem.withColumn("l_tax", bad))):
        try:
            P.assert_finite(table)
            told.append((what, "finite"))
        except OperatorError as e:
            told.append((what, str(e).split(":")[0]))
    return t.spark.createDataFrame(told, "what string, told string")


@query("select count(*) as rows, true as near from (select l_returnflag, l_shipmode, l_quantity from lineitem)"
       .replace("l_shipmode", "l_linestatus"))
def repeated_rows_estimated(t):
    """The estimate of repeated rows against their exact number: within 5 % of the rows."""
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")
    exact = P.profile(rows).repeated_rows.first()[0]
    guess = P.profile(rows, exact=False).repeated_rows.first()[0]
    return rows.agg(F.count("*").alias("rows"), (F.abs(F.lit(guess) - F.lit(exact)) <= F.count("*") * 0.05).alias("near"))


@query("""select o_orderkey, date_diff('day', o_orderdate::date, date '2024-05-17') as age, o_orderdate < timestamp '2024-05-17 10:11:12' as past,
                 '2024-05-17' as today, '2024-05-17 10:11:12.5' as now from orders""")
def clock_of_a_run(t):
    clock = X.Clock(dt.datetime(2024, 5, 17, 10, 11, 12, 500_000))
    return t.orders.select("o_orderkey", F.datediff(clock.today(), F.col("o_orderdate").cast("date")).cast("bigint").alias("age"),
                           (F.col("o_orderdate") < clock.now()).alias("past"), clock.today().cast("string").alias("today"),
                           clock.now().cast("string").alias("now"))


@query("""select count(*) as rows, count(distinct (l_orderkey, l_linenumber, l_quantity)) as hashes,
                 count(distinct (l_quantity, l_tax)) as fewer from lineitem""")
def row_hashes(t):
    """As many different hashes as different rows."""
    whole, part = X.row_hash(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")), X.row_hash(F.col("l_quantity"), F.col("l_tax"))
    return t.lineitem.agg(F.count("*").alias("rows"), F.countDistinct(whole).alias("hashes"), F.countDistinct(part).alias("fewer"))


@query("""select c_custkey, case when c_custkey % 4 in (0, 1) then c_custkey % 4 = 0 end as said,
                 case when c_custkey % 3 = 0 then null else c_acctbal end as number,
                 format('{:,}', c_custkey) || ' byte' || case when c_custkey = 1 then '' else 's' end as size from customer where c_custkey < 1024
          union all select c_custkey, case when c_custkey % 4 in (0, 1) then c_custkey % 4 = 0 end,
                 case when c_custkey % 3 = 0 then null else c_acctbal end,
                 regexp_replace(format('{:,.1f}', round_even(c_custkey / 1024.0, 1)), '\\.0$', '') || ' KB (' || format('{:,}', c_custkey) || ' bytes)'
          from customer where c_custkey >= 1024""")
def read_words_and_numbers(t):
    key = F.col("c_custkey")
    word = F.element_at(F.array(F.lit(" Yes "), F.lit("false"), F.lit("maybe"), F.lit("")), (key % 4 + 1).cast("int"))
    number = F.when(key % 3 == 0, F.concat(F.lit("~"), "c_acctbal")).otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string")))
    return t.customer.select("c_custkey", X.read_bool(word).alias("said"), X.read_number(number).alias("number"), X.size_text(key).alias("size"))


@query("""select n_nationkey, n_name, 'pandas' as how from nation union all select n_nationkey, n_name, 'arrow' from nation
          union all select n_nationkey, n_name, 'frame' from nation""")
def frames_as_tables(t):
    """A frame of another library as a table (of a table that is small by its nature)."""
    nation = t.nation.select("n_nationkey", "n_name")
    frames = {"pandas": nation.toPandas(), "arrow": nation.toArrow(), "frame": nation}
    made = [as_table(t.spark, frame).withColumn("how", F.lit(how)) for how, frame in frames.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("""select o_orderkey::bigint as key, o_custkey::bigint as customer, o_totalprice::float::double as price, o_orderdate as at,
                 lower(hex(o_orderstatus::blob)) as raw, o_totalprice::decimal(12, 2) as exact from orders""")
def database_types(t):
    """The types that rows of a database are brought to."""
    return normalise_jdbc_types(t.orders.select(
        F.col("o_orderkey").cast("int").alias("key"), F.col("o_custkey").cast("int").alias("customer"), F.col("o_totalprice").cast("float").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").cast("binary").alias("raw"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("exact")))


@query("""select n_regionkey as region, count(*) as nations, '/2024/05/nations-17.parquet' as path from nation group by all""")
def dated_path(t):
    """Written to a path with a date in it, and read from there."""
    base = _scratch(t, "dated")
    path = render_path("{{base}}/{{day:%Y/%m}}/nations-{{day:%d}}.parquet", {"base": base, "day": dt.date(2024, 5, 17)})
    write_table(t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations")), path)
    return read_table(t.spark, path).withColumn("path", F.lit(path.removeprefix(base)))


@query("""select 'big' as part, n_regionkey as region, count(*) as nations from nation where n_nationkey >= 10 group by all
          union all select 'small', n_regionkey, count(*) from nation where n_nationkey < 10 group by all""")
def own_python(t):
    """Your own function with settings and two outputs, as a step and as a call."""
    def cut(table, limit):
        by = lambda some: some.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
        return {"big": by(table.where(F.col("n_nationkey") >= limit)), "small": by(table.where(F.col("n_nationkey") < limit))}

    step = Step("cut", cut, outputs=("big", "small"), settings={"limit": ("int", 5)})
    big = step(t.nation, limit="10")["big"]
    small = run_python(cut, t.nation, ("big", "small"), {"limit": 10}, "cut")["small"]
    return big.select(F.lit("big").alias("part"), "*").unionByName(small.select(F.lit("small").alias("part"), "*"))


@query("""select * from (values ('It is there', 'passed', '6 here'), ('Not empty', 'passed', 'each file holds something'),
                                ('Size', 'warned', null)) as v("check", outcome, details)
          union all select 'rows', 'read', count(*)::varchar from orders
          union all select 'too small', 'named', '6' from (select 1)""")
def checked_files(t):
    """The files of a written table, listed and checked: six of them, each with rows, each under 100 GB."""
    path = _scratch(t, "listed")
    t.orders.repartitionByRange(6, "o_orderkey").write.parquet(path)
    found = check_files(list_files(t.spark, f"{path}/*.parquet"), not_empty=True, minimum="100 GB", warn=("size",))
    results = found.results.select("check", "outcome", F.when(F.col("check") != "Size", F.col("details")).alias("details"))
    rows = t.spark.read.parquet(path).agg(F.lit("rows").alias("check"), F.lit("read").alias("outcome"), F.count("*").cast("string").alias("details"))
    small = found.broken.where("check = 'Size'").agg(F.lit("too small").alias("check"), F.lit("named").alias("outcome"), F.count("*").cast("string").alias("details"))
    return results.unionByName(rows).unionByName(small)


@query(f"""with {RUNS}, s as (select l_orderkey + 1 as run_id, l_linenumber, l_returnflag, l_shipdate, l_quantity,
                                     l_partkey * 1000000 + l_suppkey * 100 + l_quantity::bigint as seq from lineitem
                              qualify row_number() over (partition by run_id, l_linenumber order by seq desc) = 1),
    d as (select flow_path, 'step ' || l_linenumber as step, l_shipdate::date as day, max(l_quantity)::double as v
          from s join runs using (run_id) where l_returnflag <> 'R' group by all),
    h as (select *, list(v) over (partition by flow_path, step, isodow(day) order by day rows between 8 preceding and 1 preceding) as past from d),
    m as (select *, list_aggregate(past, 'median') as mid from h where len(past) >= 4),
    e as (select *, list_transform(past, lambda x: abs(x - mid)) as apart from m),
    r as (select *, case when list_aggregate(apart, 'median') > 0 then 1.4826 * list_aggregate(apart, 'median')
                    else 1.2533 * list_aggregate(apart, 'avg') end as spread from e)
    select flow_path, step, day::varchar as day, v as seconds, round(mid, 6) as expected from r where v < mid - 3 * spread or v > mid + 3 * spread""")
def unusual_durations(t):
    """Steps that took unusually long or short for their weekday."""
    found = detect_anomalies(step_durations(_runs(t), _steps(t)), "day", ["seconds"], ["flow_path", "step"], only_latest=False).anomalies
    return found.select("flow_path", "step", F.col("day").cast("string").alias("day"), "seconds", F.round("seconds_expected", 6).alias("expected"))


@query("""select 'l_suppkey' as "column", count(l_suppkey) as "count", true as distinct_near, true as median_near from lineitem
          union all select 'l_extendedprice', count(l_extendedprice), true, true from lineitem
          union all select 'l_shipdate', count(l_shipdate), true, null from lineitem""")
def estimates_of_merged_sketches(t):
    """Sketches by supplier group, merged: distinct values within 6 %, the median with half the rows, give or take 1 %."""
    columns = ["l_suppkey", "l_extendedprice", "l_shipdate"]
    lines = t.lineitem.select(*columns, (F.col("l_suppkey") % 5).alias("part"))
    found = {r["column"]: r for r in estimates(sketch(lines, columns, ["part"])).collect()}
    told = []
    for c in columns:
        r, distinct = found[c], F.countDistinct(c)
        half = F.count(c) / 2
        median = (F.count_if(F.col(c) < r["median"]) <= half * 1.02) & (F.count_if(F.col(c) <= r["median"]) >= half * 0.98) if r["median"] is not None else F.lit(None).cast("boolean")
        told.append(F.struct(F.lit(c).alias("column"), F.lit(r["count"]).alias("count"), (F.abs(distinct - F.lit(r["distinct"])) <= distinct * 0.06).alias("distinct_near"),
                             median.alias("median_near")))
    return lines.agg(F.array(*told).alias("told")).select(F.inline("told"))


@query("""select o_custkey, o_orderkey, cast(sum(o_totalprice::decimal(15, 2)) over (partition by o_custkey order by o_orderkey) as double) as upto from orders""")
def running_python(t):
    """A customer's orders in order, in Python, a batch at a time, in chunks that are put together."""
    import pandas as pd

    def spent(state, frame):
        cents = state + (frame["o_totalprice"].to_numpy() * 100).round().astype("int64").cumsum()
        return int(cents[-1]), pd.DataFrame({"o_orderkey": frame["o_orderkey"].to_numpy(), "upto": cents / 100})

    return in_order(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", spent, "o_orderkey long, upto double",
                    start=lambda: 0, combine=lambda a, b: a + b)
