"""Queries of the run ledger, files and streaming pickup."""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.anomalies import detect_anomalies
from ..operators.checks import Conditions, RowCount, RowCountCompared, check_table
from ..operators.file_checks import check_files
from ..operators.ledger import (Ledger, carried_on, earlier_run, last_run, last_success, latest_per_step, latest_per_version, latest_runs,
                                latest_state, lineage_roots, previous_success, retain, search, step_durations, step_results,
                                steps_in_order)
from ..operators.relational import asof_join, status_rollup
from ..plans.lineage import checkpoint_dir
from ..sources.commits import commit_table, read_committed, versions
from ..sources.files import list_files, materialise, read_table, write_table
from ..streaming.pickup import Pickup, freshness_of_batches
from .registry import query


def _number(x: str) -> str:
    """A number as messages show it, in SQL."""
    return f"regexp_replace(format('{{:,.2f}}', {x}), '\\.?0+$', '')"


def _scratch(t, name: str) -> str:
    """A new folder in the cluster's shared folder."""
    return posixpath.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


# Orders as runs of a flow per priority, their lines as steps.
RUNS = """runs as (select o_orderkey + 1 as run_id, o_orderpriority as flow_path,
    case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'running' end as status, o_orderdate as started,
    o_orderdate + interval 1 hour as finished, case when o_custkey % 3 = 0 then 'manual, nightly' when o_custkey % 3 = 1 then 'manual'
    else '' end as counts_for, 'v' || o_custkey % 20 as version from orders)"""
STEPS = """steps as (select * from (select l_orderkey + 1 as run_id, 'step ' || l_linenumber as step,
    case l_returnflag when 'A' then 'success' when 'N' then 'failed' else 'running' end as status, l_quantity::bigint as rows,
    l_partkey * 1000000 + l_suppkey * 100 + l_quantity::bigint as seq from lineitem)
    qualify row_number() over (partition by run_id, step order by seq desc, rows desc) = 1)"""


def _runs(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    counts = F.when(F.col("o_custkey") % 3 == 0, "manual, nightly").when(F.col("o_custkey") % 3 == 1, "manual").otherwise("")
    return t.orders.select(
        (F.col("o_orderkey") + 1).alias("run_id"), F.col("o_orderpriority").alias("flow_path"), status.alias("status"),
        F.col("o_orderdate").alias("started"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("finished"),
        counts.alias("counts_for"), counts.alias("started_by"), F.concat(F.lit("v"), F.col("o_custkey") % 20).alias("version"))


def _steps(t) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "failed").otherwise("running")
    rows = F.col("l_quantity").cast("bigint")
    events = t.lineitem.select(
        (F.col("l_orderkey") + 1).alias("run_id"), F.concat(F.lit("step "), "l_linenumber").alias("step"), status.alias("status"),
        rows.alias("rows"), F.col("l_shipdate").alias("started"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_quantity").cast("decimal(18,6)"))).alias("finished"),
        F.lit(1).alias("attempts"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + rows).alias("seq"))
    return latest_state(events, ["run_id", "step"], "seq")


@query(f"""with {RUNS}, {STEPS}, r as (select s.run_id, s.step, s.status, s.rows, runs.flow_path from steps s join runs using (run_id)
                                       where s.status <> 'running')
    select run_id, step, flow_path,
           last_value(case when status = 'success' then run_id end ignore nulls) over w as previous_run,
           last_value(case when status = 'success' then rows end ignore nulls) over w as previous_rows
    from r window w as (partition by flow_path, step order by run_id rows between unbounded preceding and 1 preceding)""")
def ledger_previous_success(t):
    return previous_success(_runs(t), _steps(t)).select("run_id", "step", "flow_path", "previous_run", "previous_rows")


@query(f"""with {RUNS}, {STEPS}
    select run_id, rows from steps join runs using (run_id) where step = 'step 2' and flow_path = '1-URGENT'
    and steps.status = 'success' and run_id < (select max(run_id) from runs) order by run_id desc limit 1""")
def ledger_last_success(t):
    runs = _runs(t)
    newest = runs.agg(F.max("run_id")).first()[0]
    return last_success(runs, _steps(t), "1-URGENT", "step 2", newest).select("run_id", "rows")


@query(f"""with {RUNS}, {STEPS}
    select flow_path, step, max(run_id) as run_id, arg_max(steps.status, run_id) as status, arg_max(rows, run_id) as rows
    from steps join runs using (run_id) where steps.status <> 'running' and run_id > 100 group by 1, 2""")
def ledger_latest_per_step(t):
    found = latest_per_step(_runs(t), _steps(t), after=100)
    return found.select("flow_path", "step", "run_id", "status", "rows")


@query(f"""with {RUNS} select flow_path, version, max(run_id) as run_id, arg_max(started, run_id)::varchar as started
           from runs where status <> 'running' group by 1, 2""")
def ledger_latest_per_version(t):
    found = latest_per_version(_runs(t))
    return found.select("flow_path", "version", "run_id", F.col("started").cast("string").alias("started"))


@query(f"""with {RUNS} select run_id, status from runs where flow_path = '2-HIGH' order by run_id desc limit 200""")
def ledger_latest_runs(t):
    return latest_runs(_runs(t), "2-HIGH").select("run_id", "status")


@query(f"""with {RUNS} select run_id, status from runs where flow_path = '3-MEDIUM' and status <> 'running'
           and ', ' || counts_for || ', ' like '%, nightly, %' order by run_id desc limit 1""")
def ledger_last_run_of_start(t):
    return last_run(_runs(t), "3-MEDIUM", ["nightly", "hourly"]).select("run_id", "status")


@query(f"""with {RUNS}, {STEPS} select run_id, steps.status, rows from steps join runs using (run_id)
           where step = 'step 1' and flow_path = '5-LOW' and steps.status <> 'running' order by run_id desc limit 200""")
def ledger_step_results(t):
    return step_results(_runs(t), _steps(t), "5-LOW", "step 1").select("run_id", "status", "rows")


@query(f"""with {STEPS} select step, status, rows from steps where status <> 'running' and run_id = (select max(run_id) from steps)""")
def ledger_steps_of_run(t):
    steps = _steps(t)
    newest = steps.agg(F.max("run_id")).first()[0]
    return steps_in_order(steps, newest).select("step", "status", "rows")


@query(f"""with {RUNS}, {STEPS}, b as (select run_id, rows from steps join runs using (run_id) where step = 'step 1'
             and flow_path = '1-URGENT' and steps.status = 'success' and run_id < (select max(run_id) from runs)
             order by run_id desc limit 1)
    select 'Row count compared with the last successful run' as "check",
           case when abs((select count(*) from orders) - rows) / rows * 100 <= 30 then 'passed' else 'warned' end as outcome from b""")
def ledger_row_count_compared(t):
    runs = _runs(t)
    earlier = earlier_run(runs, _steps(t), "1-URGENT", "step 1", runs.agg(F.max("run_id")).first()[0])
    return check_table(t.orders, [RowCountCompared(earlier=earlier, if_fails="warn")]).results.select("check", "outcome")


KEEPS = """keeps as (select flow_path, start, keep, start = 'nightly' as keep_failed from (values
    ('1-URGENT', 'last 100'), ('2-HIGH', '3 years'), ('3-MEDIUM', 'all'), ('4-NOT SPECIFIED', null), ('5-LOW', 'last 5')) k(flow_path, keep),
    (values ('manual'), ('nightly')) s(start))"""


def _keeps(t) -> DataFrame:
    flow = F.col("flow_path")
    keep = (F.when(flow == "1-URGENT", "last 100").when(flow == "2-HIGH", "3 years").when(flow == "3-MEDIUM", "all")
            .when(flow == "5-LOW", "last 5"))
    flows = t.orders.select(F.col("o_orderpriority").alias("flow_path")).distinct()
    starts = flows.select("flow_path", keep.alias("keep"), F.explode(F.array(F.lit("manual"), F.lit("nightly"))).alias("start"))
    return starts.withColumn("keep_failed", F.col("start") == "nightly")


@query(f"""with {RUNS}, {KEEPS}, f as (select * from runs where status <> 'running'),
    c as (select f.*, unnest(string_split(counts_for, ', ')) as start from f where counts_for <> ''),
    n as (select *, row_number() over (partition by flow_path, start order by run_id desc) - 1 as newer from c),
    g as (select run_id, bool_and(case when keep_failed and status = 'failed' then false
            when keep like 'last %' then newer >= regexp_extract(keep, '[0-9]+')::int
            when keep = 'all' then false when keep = '3 years' then started < timestamp '1998-09-01'
            else started < timestamp '1996-09-01' end) as goes from n join keeps using (flow_path, start) group by run_id),
    gone as (select run_id from g where goes union all select run_id from f where counts_for = '' and started < timestamp '1996-09-01')
    select run_id, flow_path from runs where run_id not in (select run_id from gone)""")
def retention(t):
    return retain(_runs(t), _keeps(t), dt.datetime(2001, 9, 1)).select("run_id", "flow_path")


CHAIN = """chain as (select o_orderkey + 1 as run_id, lag(o_orderkey + 1) over (partition by o_custkey order by o_orderkey) as parent
                     from orders)"""


def _lineage(t) -> DataFrame:
    """Each order carried on from the customer's order before it."""
    ours = t.orders.select("o_custkey", (F.col("o_orderkey") + 1).alias("run_id"))
    theirs = ours.select("o_custkey", F.col("run_id").alias("carried_on_from"))
    return asof_join(ours, theirs, "o_custkey", "run_id", "carried_on_from", ["carried_on_from"], strict=True).where(
        "carried_on_from IS NOT NULL").select("run_id", "carried_on_from")


@query(f"""with {CHAIN}, f as (select *, o_custkey from chain join orders on o_orderkey + 1 = run_id)
    select run_id, min(run_id) over (partition by o_custkey) as root,
           row_number() over (partition by o_custkey order by run_id) - 1 as depth
    from f qualify depth > 0""")
def lineage_closure(t):
    return lineage_roots(_lineage(t))


@query(f"""with recursive {CHAIN}, later(run_id) as (select run_id from chain where parent = (select min(parent) from chain)
    union select c.run_id from chain c join later l on c.parent = l.run_id) select run_id from later""")
def lineage_of_one_run(t):
    lineage = _lineage(t)
    first = lineage.agg(F.min("carried_on_from")).first()[0]
    return carried_on(lineage, first)


@query("""select o_custkey, concat_ws(' ', case when s > 0 then '✓ ' || s end, case when f > 0 then '✕ ' || f end,
                 case when k > 0 then 'skipped ' || k end) as ended,
                 case when f > 0 then 'failed' when s > 0 then 'success' else 'skipped' end as status
          from (select o_custkey, count(*) filter (where o_orderstatus = 'F') as s, count(*) filter (where o_orderstatus = 'O') as f,
                       count(*) filter (where o_orderstatus = 'P') as k from orders group by o_custkey)""")
def status_of_items(t):
    ends = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "success").when(
        F.col("o_orderstatus") == "O", "failed").otherwise("skipped").alias("status"))
    return status_rollup(ends, ["o_custkey"])


@query(f"""with {RUNS}, s as (select l_orderkey + 1 as run_id, l_linenumber, l_returnflag, l_shipdate, l_quantity,
                                    l_partkey * 1000000 + l_suppkey * 100 + l_quantity::bigint as seq from lineitem
                             qualify row_number() over (partition by run_id, l_linenumber order by seq desc) = 1)
    select flow_path, 'step ' || l_linenumber as step, l_shipdate::date::varchar as day, count(*) as runs,
           max(l_quantity) as seconds, count(*) as attempts
    from s join runs using (run_id) where l_returnflag <> 'R' group by all""")
def ledger_step_durations(t):
    found = step_durations(_runs(t), _steps(t))
    return found.withColumn("day", F.col("day").cast("string"))


@query(f"""with {RUNS}, s as (select l_orderkey + 1 as run_id, l_linenumber, l_returnflag, l_shipdate, l_quantity,
                                     l_partkey * 1000000 + l_suppkey * 100 + l_quantity::bigint as seq from lineitem
                              qualify row_number() over (partition by run_id, l_linenumber order by seq desc) = 1),
    d as (select flow_path, 'step ' || l_linenumber as step, l_shipdate::date as day, max(l_quantity)::double as v
          from s join runs using (run_id) where l_returnflag <> 'R' group by all),
    h as (select *, list(v) over (partition by flow_path, step, isodow(day) order by day rows between 8 preceding and 1 preceding) as past from d),
    m as (select *, list_aggregate(past, 'median') as expected, dayname(day) as name from h where len(past) >= 4),
    e as (select *, list_transform(past, lambda x: abs(x - expected)) as apart from m),
    r as (select *, case when list_aggregate(apart, 'median') > 0 then 1.4826 * list_aggregate(apart, 'median')
                    else 1.2533 * list_aggregate(apart, 'avg') end as spread from e),
    b as (select *, expected - 3 * spread as low, expected + 3 * spread as high from r)
    select flow_path, step, day, v as seconds, left(name, 3) || ' ' || day::varchar || ', ' || flow_path || ', ' || step || ': seconds ' || {_number('v')} || case
             when spread = 0 then '; the ' || len(past) || ' earlier ' || name || 's were all ' || {_number('expected')}
             else '; a usual ' || name || ' is ' || {_number('expected')} || ' (' || {_number('low')} || '–' || {_number('high')} || ')' end as reason
    from b where v < low or v > high""")
def ledger_unusual_durations(t):
    days = step_durations(_runs(t), _steps(t)).withColumn("day", F.col("day"))
    found = detect_anomalies(days, "day", ["seconds"], ["flow_path", "step"], only_latest=False)
    return found.anomalies.select("flow_path", "step", "day", "seconds", "reason")


@query("""select doc_id, case when regexp_matches(source, 'eb|oo') then 0 when regexp_matches(lang, 'eb|oo') then 1
                         else 2 end::int as rank,
                 case when regexp_matches(source, 'eb|oo') then 'source' when regexp_matches(lang, 'eb|oo') then 'lang' else 'text' end
                   as found_in
          from documents where regexp_matches(source, 'eb|oo') or regexp_matches(lang, 'eb|oo') or regexp_matches(text, 'eb|oo')""")
def search_texts(t):
    return search(t.documents, "eb|oo", "doc_id", ["source", "lang", "text"])


# --- files ------------------------------------------------------------------------------------------------------

@query("""select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment
          from customer""")
def csv_round_trip(t):
    customers = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return read_table(t.spark, write_table(customers, _scratch(t, "customers") + ".csv"))


@query("""select doc_id, text, lang from documents""")
def csv_of_texts(t):
    """Texts with line ends and quotes."""
    return read_table(t.spark, write_table(t.documents.select("doc_id", "text", "lang"), _scratch(t, "documents") + ".csv"))


@query("select o_orderkey, o_totalprice * 2 as o_totalprice, o_orderdate::date::varchar as day from orders")
def parquet_over_itself(t):
    path = write_table(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day")),
                       _scratch(t, "orders") + ".parquet")
    write_table(read_table(t.spark, path).withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    return read_table(t.spark, path).withColumn("day", F.col("day").cast("string"))


@query("""select 1 as version, o_orderstatus, count(*) as n from orders group by all
          union all select 2, o_orderstatus, count(*) from orders where o_totalprice > 100000 group by all
          union all select 3, o_orderstatus, 2 * count(*) from orders where o_totalprice > 100000 group by all""")
def committed_versions(t):
    """A table made from itself twice, each time as a version of its own."""
    path = _scratch(t, "orders") + ".parquet"
    write_table(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, commits=True)
    write_table(read_table(t.spark, path).where("o_totalprice > 100000"), path)
    commit_table(read_table(t.spark, path).unionByName(read_table(t.spark, path)), path, expected=2)
    counted = [read_committed(t.spark, path, v).groupBy(F.lit(v).alias("version"), "o_orderstatus").agg(F.count("*").alias("n")) for v in versions(t.spark, path)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by 1")
def materialised_step(t):
    kept = materialise(t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n")))
    return kept.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("quantity"))


@query("""select * from (values ('It is there', 'passed', '4 here'), ('Not empty', 'passed', 'each file holds something'),
                   ('Modified since', 'passed', 'each file is from 1990-01-01 00:00:00 or later'),
                   ('Size', 'passed', 'each file is at least 100 B and at most 100 GB')) as v("check", outcome, details)
          union all select 'rows', 'read', format('{:,}', count(*)) from customer""")
def file_listing_checks(t):
    """The files that a table is written as, listed and checked, and the rows that they hold."""
    path = _scratch(t, "files")
    t.customer.repartitionByRange(4, "c_custkey").write.parquet(path)
    files = list_files(t.spark, posixpath.join(path, "*.parquet"))
    found = check_files(files, not_empty=True, modified_since=dt.date(1990, 1, 1), minimum="100 B", maximum="100 GB").results
    rows = t.spark.read.parquet(path).agg(F.lit("rows").alias("check"), F.lit("read").alias("outcome"), F.format_number(F.count("*"), 0).alias("details"))
    return found.unionByName(rows)


@query("""select 'success' as status, count(*) as rows from events""")
def streamed_pickup(t):
    """The events file picked up as a stream, checked, delivered and entered in a ledger."""
    base = _scratch(t, "pickup")
    ledger = Ledger(t.spark, f"{base}/ledger")
    Pickup(t.spark, t.folder, t.events.schema, f"{base}/checkpoint", [RowCount(at_least=1), Conditions(rules=["value >= 0"])],
           f"{base}/events", ledger=ledger, options={"pathGlobFilter": "events.parquet"}).run()
    return freshness_of_batches(ledger).groupBy("status").agg(F.sum("rows").alias("rows"))
