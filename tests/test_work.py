"""Joins, Python code, calendars, schedules, the ledger and streaming."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import (Calendar, Conditions, Ledger, OperatorError, Pickup, RowCount, Step, asof_join, attach,
                       business_days_between, clock_to_utc, cron_due, due_times, for_each_row, is_business_day,
                       merge_lines, misfire, overlapping_runs, parse_cron, per_group, preview, range_join, route, run_python, scrub,
                       shift_business_days, write_table)
from plumbline.operators.ledger import (carried_on, latest_per_step, last_success, lineage_roots, parse_keep, retain, search)
from plumbline.operators.relational import secret_forms, showing, status_rollup
from plumbline.plans import ordered as O
from plumbline.streaming.pickup import freshness_of_batches


def T(*parts):
    return dt.datetime(*parts)


@pytest.mark.parametrize("rows", [10 ** 6, 9])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_definition(spark, rows, strict):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "b", None]), rng.randrange(40)) for i in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(40), i, None if i % 9 == 0 else float(i)) for i in range(60)]
    found = asof_join(spark.createDataFrame(left, "i int, k string, t bigint"), spark.createDataFrame(right, "k string, rt bigint, o int, v double"),
                      "k", "t", "rt", ["v", "rt"], strict=strict, right_order=["o"], rows=rows)
    got = {r.i: (r.rt, r.v) for r in found.collect()}
    for i, k, t in left:
        before = [(rt, o, v) for rk, rt, o, v in right if rk == k and (rt < t if strict else rt <= t)]
        best = max(before, key=lambda b: b[:2], default=(None, None, None))
        assert got[i] == (best[0], best[2])
    assert len(got) == len(left)


def test_asof_of_two_types(spark):
    left = spark.createDataFrame([(1, dt.date(2026, 1, 2)), (1, None), (2, dt.date(2026, 1, 5))], "k int, d date")
    right = spark.createDataFrame([(1, T(2026, 1, 1, 9), "a"), (1, T(2026, 1, 2, 9), "b"), (2, T(2026, 1, 5), "c")], "k bigint, at timestamp_ntz, v string")
    found = asof_join(left, right, "k", "d", "at", ["v"])
    assert {(r.k, r.d): r.v for r in found.collect()} == {(1, dt.date(2026, 1, 2)): "a", (1, None): None, (2, dt.date(2026, 1, 5)): "c"}
    assert dict(found.dtypes) == {"k": "int", "d": "date", "v": "string"}


def test_asof_with_copies_and_busy_moments(spark):
    """Many rows with one key and time on both sides: each left row still gets the latest right one."""
    left = spark.range(3000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), "id")
    right = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") % 5).alias("rt"), F.col("id").alias("o"), F.col("id").alias("v"))
    found = asof_join(left, right, "k", "t", "rt", ["v"], right_order=["o"])
    assert found.count() == 3000 and [r.v for r in found.select("v").distinct().collect()] == [2999]


def test_range_join_by_definition(spark):
    rng = random.Random(4)
    spans = [(j, "ab"[j % 2], s, s + rng.choice([0, 1, 2, 7, 64, 1000])) for j, s in enumerate(rng.randrange(1000) for _ in range(80))]
    points = [(i, rng.choice("ab"), rng.randrange(1200)) for i in range(200)]
    found = range_join(spark.createDataFrame(points, "i int, k string, p bigint"), spark.createDataFrame(spans, "j int, k string, lo bigint, hi bigint"),
                       "p", "lo", "hi", ["k"])
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, k, p in points for j, k2, lo, hi in spans if k == k2 and lo <= p < hi)


@pytest.mark.parametrize("size", [10 ** 6, 5])
def test_running_over_chunks(spark, size):
    rng = random.Random(1)
    rows = [(rng.choice([1, None]), i, rng.randrange(9), None if rng.random() < 0.4 else rng.randrange(100)) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, t bigint, a bigint, v int").withColumn(O.KEY, O.key_of(["g"]))
    got = {r.t: (r.s, r.m, r.l) for r in O.running(df, O.KEY, ["t"], {"s": ("sum", "a"), "m": ("max", "a"), "l": ("last", "v")},
                                                  rows=size).collect()}
    for g, t, _, _ in rows:
        mine = [r for r in rows if r[0] == g and r[1] <= t]
        values = [r[3] for r in mine if r[3] is not None]
        assert got[t] == (sum(r[2] for r in mine), max(r[2] for r in mine), values[-1] if values else None)


def test_chunks_of_one_group_and_one_moment(spark):
    """A group with all rows, a third of them at one time, is cut into chunks of like size, in order."""
    df = spark.range(3000).select(F.struct(F.lit(1).alias("g")).alias(O.KEY), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("t"), "id")
    found, one = O.in_chunks(df, O.KEY, ["t", "id"], 200)
    chunks = found.groupBy(O.CHUNK).agg(F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).orderBy(O.CHUNK).collect()
    assert not one and len(chunks) >= 10 and max(c.n for c in chunks) <= 800 and sum(c.n for c in chunks) == 3000
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(chunks, chunks[1:]))


def test_top_per_group_of_many(spark):
    from plumbline.plans.ranked import top_per_group

    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    found = top_per_group(df, ["g"], [F.desc("id")], 1500)
    assert found.count() == 3000 and found.agg(F.min("id")).first()[0] == 2000 and found.columns == ["g", "id", "rank"]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_times_on_their_own_clock(spark, zone):
    """Microseconds of a clock time do not depend on the session's zone, also where its clock jumps."""
    from plumbline.functions.readers import micros, moment_of

    walls = [T(2024, 3, 31, 2, 30), T(2024, 3, 31, 3, 30), T(1969, 12, 31, 23, 59, 59, 999999), T(2024, 10, 27, 2, 30, 0, 5)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(w,) for w in walls], "w timestamp_ntz").select("w", micros(F.col("w")).alias("us"))
        rows = df.select("w", "us", moment_of(F.col("us")).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.us for r in rows] == [(w - T(1970, 1, 1)) // dt.timedelta(microseconds=1) for w in walls]
    assert [r.back for r in rows] == walls


def test_for_each_row(spark):
    items = spark.createDataFrame([("b", 2), ("a", 1), ("c", 9)], "region string, least int")
    sales = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "region string, n int")
    found = for_each_row(spark, items, "select count(*) as rows from sales where region = item.region and n >= item.least", {"sales": sales},
                         order_by=["region"])
    assert [tuple(r) for r in found.orderBy("item_index").collect()] == [(1, "a", 1, 2), (2, "b", 2, 0), (3, "c", 9, 0)]
    assert for_each_row(spark, items.limit(0), "select 1 as x", order_by=["region"]).count() == 0


def test_lines_routes_and_attach(spark):
    df = spark.range(3)
    assert merge_lines({"x": df, "y": df.withColumn("z", F.lit(1))}).columns == ["line", "id", "z"]
    for wrong in ({"lines": {"x": df}, "failed": ["y"]}, {"lines": {"x": None}}, {"lines": {}}):
        with pytest.raises(OperatorError):
            merge_lines(**wrong)
    assert route(df, "count(*) > 5")[0] is None and route(df, lambda d: True)[0] is df
    with pytest.raises(OperatorError, match="already has x"):
        attach(df.withColumn("x", F.lit(1)), df.withColumn("x", F.lit(1)), "id")
    assert showing(df, 2)[1] == "Showing 2 of 3 rows." and showing(df, 3)[1] == ""
    assert preview(spark.range(20), ["id"]).count() == 10 and preview(spark.range(10), ["id"]).count() == 10


def test_scrub(spark):
    secret = 'pa"ss/wörd'
    forms = secret_forms([secret, "abc"])
    assert secret in forms and "abc" not in forms and forms == sorted(forms, key=lambda f: (-len(f), f))
    texts = [f"x {secret} y", 'pa\\"ss/wörd', "pa%22ss%2Fw%C3%B6rd", "pa\\\"ss/w\\u00f6rd", "none", None]
    got = [r.t for r in scrub(spark.createDataFrame([(t, 1) for t in texts], "t string, n int"), [secret, "abc"]).collect()]
    assert got == ["x *** y", "***", "***", "***", "none", None]
    assert scrub(spark.createDataFrame([("abcdef abcd",)], "t string"), ["abcd", "bcdef"]).first().t == "a*** ***"


def test_status_rollup(spark):
    df = spark.createDataFrame([(1, s) for s in ["success"] * 4 + ["failed"]] + [(2, "skipped"), (2, "success")], "k int, status string")
    assert {r.k: (r.ended, r.status) for r in status_rollup(df, ["k"]).collect()} == {1: ("✓ 4 ✕ 1", "failed"), 2: ("✓ 1 skipped 1", "success")}


# --- Python code ------------------------------------------------------------------------------------------------

def test_python(spark):
    found = run_python(lambda sales: {"big": sales.where("id > 1"), "n": 5, "pandas": pd.DataFrame({"a": [1]})}, {"sales": spark.range(3)},
                       ("big", "n", "pandas"))
    assert found["big"].count() == 1 and found["n"] == 5 and found["pandas"].first().a == 1
    step = Step("double", lambda table, by: table.withColumn("id", F.col("id") * by), settings={"by": 2})
    assert step(spark.range(3))["output"].agg(F.sum("id")).first()[0] == 6 and step(spark.range(3), by=10)["output"].count() == 3
    with pytest.raises(OperatorError, match="ZeroDivisionError"):
        run_python(lambda table: 1 / 0, spark.range(1), wanted=("table",))
    typed = Step("head", lambda table, n: table.limit(n), settings={"n": ("int", "2")})
    assert typed(spark.range(9))["output"].count() == 2 and typed(spark.range(9), n="5")["output"].count() == 5
    with pytest.raises(OperatorError, match="parameter 'n'"):
        typed(spark.range(9), n="many")
    with pytest.raises(OperatorError, match="not a setting"):
        step(spark.range(1), nope=1)


def test_per_group_merges_many_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit(None)).alias("k"), "id")
        sizes = []

        def partial(rows: pd.DataFrame) -> pd.DataFrame:
            assert len(rows) <= 50
            return pd.DataFrame({"k": [rows["k"].iloc[0]], "s": [rows["id"].sum()], "n": [len(rows)]})

        def merge(states: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [states["k"].iloc[0]], "s": [states["s"].sum()], "n": [states["n"].sum()]})

        got = {r.k: (r.s, r.n) for r in per_group(df, "k", partial, merge, "k string, s bigint, n bigint").collect()}
        assert got == {"hot": (sum(i for i in range(5000) if i % 3), 3333), None: (sum(range(0, 5000, 3)), 1667)} and not sizes
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- calendars and schedules ---------------------------------------------------------------------------------------

def test_business_days(spark):
    def shifted(day, n, **calendar):
        df = spark.createDataFrame([(day,)], "d date")
        return shift_business_days(df, "d", n, "to", Calendar(**calendar)).first()["to"]

    monday = dt.date(2026, 10, 5)
    assert shifted(monday, -1) == dt.date(2026, 10, 2) and shifted(monday, 0) == monday
    assert shifted(monday, -1, added=(dt.date(2026, 10, 2),)) == dt.date(2026, 10, 1)
    assert shifted(dt.date(2026, 10, 3), 0) == dt.date(2026, 10, 3) and shifted(dt.date(2026, 10, 3), 1) == monday
    assert shifted(monday, -1, added=(dt.date(2026, 10, 2),), removed=(dt.date(2026, 10, 2),)) == dt.date(2026, 10, 2)
    for wrong in ({"weekend": ("someday",)}, {"weekend": ("mon", "tue", "wed", "thu", "fri", "sat", "sun")}):
        with pytest.raises(OperatorError):
            Calendar(**wrong)


def test_business_days_by_stepping(spark):
    rng, off = random.Random(6), {dt.date(2026, 1, 1), dt.date(2026, 4, 3), dt.date(2026, 5, 1)}
    holidays = spark.createDataFrame([(d,) for d in off], "day date")
    calendar = Calendar(holidays=holidays)

    def open_(d):
        return d.weekday() < 5 and d not in off

    def step(d, n):
        while n:
            d += dt.timedelta(days=1 if n > 0 else -1)
            n -= (1 if n > 0 else -1) if open_(d) else 0
        return d

    rows = [(i, T(2026, 1, 1, 9, 30) + dt.timedelta(days=rng.randrange(200)), rng.randrange(-15, 16), dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(200)))
            for i in range(80)]
    df = spark.createDataFrame(rows, "i int, at timestamp_ntz, n int, other date").withColumn("day", F.col("at").cast("date"))
    found = is_business_day(business_days_between(shift_business_days(df, "at", "n", "to", calendar), "day", "other", "between", calendar),
                            "at", "open", calendar)
    for r in found.collect():
        assert r["to"].date() == step(r.at.date(), r.n) and r["to"].time() == r.at.time()
        a, b = r.day, r.other
        low, high = min(a, b), max(a, b)
        expected = sum(open_(low + dt.timedelta(days=k)) for k in range((high - low).days)) * (1 if a <= b else -1)
        assert (r["between"], r.open) == (expected, open_(r.day))


def test_clock_moments(spark):
    walls = [T(2024, 3, 31, 1, 59), T(2024, 3, 31, 2, 30), T(2024, 3, 31, 3, 0), T(2024, 10, 27, 2, 30), T(2024, 7, 1, 12)]
    df = spark.createDataFrame([(w,) for w in walls], "w timestamp_ntz").select(clock_to_utc(F.col("w"), "Europe/Berlin").alias("u"))
    assert [r.u for r in df.collect()] == [T(2024, 3, 31, 0, 59), T(2024, 3, 31, 1), T(2024, 3, 31, 1), T(2024, 10, 27, 0, 30), T(2024, 7, 1, 10)]


def test_parse_cron():
    assert parse_cron("5/15 8-10 1,15 JAN,mar MON-fri") == {"minutes": [5, 20, 35, 50], "hours": [8, 9, 10], "days": [1, 15], "months": [1, 3],
                                                           "weekdays": [1, 2, 3, 4, 5], "either": True}
    assert parse_cron("0 0 * * 7")["weekdays"] == [0] and parse_cron("0 0 * * 0-6/2")["weekdays"] == [0, 2, 4, 6]
    assert parse_cron("*/20 * * * *")["minutes"] == [0, 20, 40]
    for wrong in ("* * * *", "60 * * * *", "* * 0 * *", "5-1 * * * *", "*/0 * * * *", "x * * * *", "*/x * * * *", "*-5 * * * *", "mon * * * *"):
        with pytest.raises(OperatorError):
            parse_cron(wrong)


def due(spark, plan, after, until):
    df = spark.createDataFrame([plan], "cron string, every string, start timestamp_ntz, at timestamp_ntz")
    return [r.due_at for r in due_times(df, after, until).orderBy("due_at").collect()]


def test_due_times(spark):
    assert due(spark, ("0 7 * * MON-FRI", None, None, None), T(2026, 10, 2, 7), T(2026, 10, 6, 7)) == [T(2026, 10, 5, 7), T(2026, 10, 6, 7)]
    assert due(spark, ("0 0 13 * fri", None, None, None), T(2026, 11, 1), T(2026, 11, 30)) == [
        T(2026, 11, 6), T(2026, 11, 13), T(2026, 11, 20), T(2026, 11, 27)]
    assert due(spark, ("0 0 29 2 *", None, None, None), T(2023, 1, 1), T(2028, 12, 31)) == [T(2024, 2, 29), T(2028, 2, 29)]
    assert due(spark, (None, "5 minutes", T(2026, 1, 1, 12, 1), None), T(2026, 1, 1, 11, 50), T(2026, 1, 1, 12, 1)) == [
        T(2026, 1, 1, 11, 51), T(2026, 1, 1, 11, 56), T(2026, 1, 1, 12, 1)]
    assert due(spark, (None, None, None, T(2026, 1, 1)), T(2025, 1, 1), T(2026, 1, 1)) == [T(2026, 1, 1)]
    assert due(spark, (None, None, None, T(2026, 1, 1)), T(2026, 1, 1), T(2027, 1, 1)) == []
    with pytest.raises(OperatorError):
        due_times(spark.range(1), T(2026, 1, 1), T(2026, 1, 2))
    with pytest.raises(Exception, match="cron needs 5 fields"):
        cron_due(spark.createDataFrame([("* *",)], "cron string"), T(2026, 1, 1), T(2026, 1, 2)).collect()


def test_misfire_and_overlap(spark):
    rows = [(p, T(2026, 1, 1, h), p) for p in ("run_once", "catch_up", "skip") for h in (1, 2, 3)]
    df = spark.createDataFrame(rows, "schedule_id string, due_at timestamp_ntz, misfire string")

    def ran(now):
        return sorted((r.schedule_id, r.due_at.hour) for r in misfire(df, now).where("action = 'run'").collect())

    assert ran(T(2026, 1, 1, 3, 1, 59)) == [("catch_up", 1), ("catch_up", 2), ("catch_up", 3), ("run_once", 3), ("skip", 3)]
    assert ("skip", 3) not in ran(T(2026, 1, 1, 3, 2))
    runs = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 5, 6), ("f", 3, 9, 20), ("f", 4, 30, 31), ("g", 5, 5, 6)], "flow string, run int, a int, b int") \
        .withColumns({c: F.timestamp_seconds(c).cast("timestamp_ntz") for c in ("a", "b")})
    assert sorted(r.run for r in overlapping_runs(runs, "flow", "run", "a", "b").collect()) == [2, 3]


# --- the ledger ------------------------------------------------------------------------------------------------------

def test_one_clock(spark):
    from plumbline import Clock

    clock = Clock(T(2026, 10, 5, 8, 30))
    assert tuple(spark.range(1).select(clock.today(), clock.now()).first()) == (dt.date(2026, 10, 5), T(2026, 10, 5, 8, 30))


def test_logs_and_queries(spark, tmp_path):
    from plumbline.operators.ledger import logs_in_order, queries_sent, steps_in_order

    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.append("logs", [{"run_id": 1, "message": m, "seq": i} for i, m in ((2, "b"), (1, "a"))] + [{"run_id": 2, "message": "c", "seq": 1}])
    ledger.append("steps", [{"run_id": 1, "step": s, "status": "success", "finished": T(2026, 1, 1, h), "started": T(2026, 1, 1, h - 1), "query": q, "seq": 1}
                            for s, h, q in (("y", 5, "select 2"), ("x", 3, None), ("z", 4, "select 1"))])
    assert [r.message for r in logs_in_order(ledger.state("logs"), 1).collect()] == ["a", "b"]
    assert [r.step for r in steps_in_order(ledger.state("steps"), 1).collect()] == ["x", "z", "y"]
    assert [r.query for r in queries_sent(ledger.state("steps"), 1).collect()] == ["select 1", "select 2"]


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.state("runs").count() == 0
    for run, status in ((1, "success"), (2, "failed"), (3, "running")):
        ledger.append("runs", [{"run_id": run, "flow": "f", "flow_path": "f", "status": "running", "started": T(2026, 1, run), "started_by": "manual", "seq": 1}])
        if status != "running":
            ledger.append("runs", [{"run_id": run, "flow": "f", "flow_path": "f", "status": status, "started": T(2026, 1, run), "started_by": "manual", "seq": 2}])
        ledger.append("steps", [{"run_id": run, "step": "load", "status": "success" if run != 2 else "failed", "rows": run * 100, "seq": 1}])
    runs, steps = ledger.state("runs"), ledger.state("steps")
    assert {r.run_id: r.status for r in runs.collect()} == {1: "success", 2: "failed", 3: "running"}
    assert [r["rows"] for r in last_success(runs, steps, "f", "load", 3).collect()] == [100]
    assert latest_per_step(runs, steps).first()["rows"] == 300
    with pytest.raises(OperatorError, match="no table"):
        ledger.events("nope")


def test_lineage(spark):
    chain = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 1), (7, 6)], "run_id bigint, carried_on_from bigint")
    assert [r.run_id for r in carried_on(chain, 1).collect()] == [5, 4, 3, 2] and carried_on(chain, 9).count() == 0
    assert {r.run_id: (r.root, r.depth) for r in lineage_roots(chain).collect()} == {2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 1), 7: (6, 1)}
    runs = spark.createDataFrame([(4, "success"), (5, "running")], "run_id bigint, status string")
    assert [r.run_id for r in carried_on(chain, 1, runs).collect()] == [4]


def test_retention(spark):
    now = T(2026, 3, 31)
    runs = [(1, "f", "success", T(2020, 1, 1), ""), (2, "f", "success", T(2026, 1, 1), ""), (3, "f", "failed", T(2020, 1, 1), "a"),
            (4, "f", "success", T(2026, 1, 1), "a"), (5, "f", "success", T(2026, 2, 1), "a, b"), (6, "f", "success", T(2026, 3, 30), "a"),
            (7, "f", "running", T(2020, 1, 1), "a"), (8, "f", "success", T(2026, 2, 27), "b"), (9, "f", "success", T(2026, 2, 28), "b")]
    df = spark.createDataFrame(runs, "run_id bigint, flow_path string, status string, started timestamp_ntz, counts_for string")
    keeps = spark.createDataFrame([("f", "a", "last 1", True), ("f", "b", "1 month", False)], "flow_path string, start string, keep string, keep_failed boolean")
    # 3 failed and is kept; 4 is not the last of a; 5 is let go by a and, older than a month, by b; 8 is older than a month
    assert sorted(r.run_id for r in retain(df, keeps, now).collect()) == [2, 3, 6, 7, 9]
    assert parse_keep("last 100") == ("last", 100) and parse_keep("18 months") == ("month", 18) and parse_keep("all") == ("all", 0)
    with pytest.raises(OperatorError):
        parse_keep("some")
    with pytest.raises(Exception, match="cannot read the keep"):
        retain(df, keeps.withColumn("keep", F.lit("some")), now).collect()


@pytest.mark.parametrize("rows", [10 ** 6, 3])
def test_retention_of_the_last_n_across_chunks(spark, monkeypatch, rows):
    from plumbline.operators import ledger as L

    monkeypatch.setattr(L, "running", lambda *args, **given: O.running(*args, **given, rows=rows))
    runs = spark.range(1, 41).select(F.col("id").alias("run_id"), F.lit("f").alias("flow_path"), F.lit("success").alias("status"),
                                     F.lit("2026-01-01").cast("timestamp_ntz").alias("started"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("counts_for"))
    keeps = spark.createDataFrame([("f", "a", "last 7", False), ("f", "b", "all", False)], "flow_path string, start string, keep string, keep_failed boolean")
    kept = {r.run_id for r in retain(runs, keeps, T(2026, 2, 1)).collect()}
    assert kept == set(range(1, 41, 2)) | set(range(28, 41, 2))


def test_search(spark):
    df = spark.createDataFrame([(1, "fix load", "x"), (2, "more", "the load"), (3, "none", "none")], "id int, message string, code string")
    assert {r.id: (r["rank"], r.found_in) for r in search(df, "lo+ad", "id", ["message", "code"]).collect()} == {1: (0, "message"), 2: (1, "code")}
    assert search(df, "z*", "id", ["message"]).count() == 0


# --- streaming ---------------------------------------------------------------------------------------------------------

def test_pickup_takes_each_file_once(spark, tmp_path):
    inbox, ledger = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger"))
    inbox.mkdir()
    failures = []

    def pickup():
        Pickup(spark, str(inbox), "a int, b string", str(tmp_path / "ckpt"), [RowCount(at_least=1), Conditions(rules=["a > 0"])],
               str(tmp_path / "out"), format="csv", ledger=ledger, options={"header": "true"},
               on_failure=lambda batch, found: failures.append(found.failures)).run(max_files=1)

    (inbox / "1.csv").write_text("a,b\n1,x\n2,y\n")
    pickup()
    (inbox / "2.csv").write_text("a,b\n3,z\n")
    pickup()
    pickup()
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    (inbox / "3.csv").write_text("a,b\n-1,bad\n")
    pickup()
    assert len(failures) == 1 and "a > 0: 1 row break it" in failures[0][0]
    assert {r.batch: (r.status, r["rows"]) for r in freshness_of_batches(ledger).collect()} == {0: ("success", 2), 1: ("success", 1), 2: ("failed", None)}
