"""Cases that once went wrong: several files, odd names, circles, times of day, many secrets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import AllowedValues, OperatorError, Unique, check_table, detect_anomalies, records_to_table, with_literals, with_row_number
from plumbline.functions import scalars as X
from plumbline.operators.checks import repeated_keys, unread_values
from plumbline.operators.file_checks import check_files
from plumbline.operators.ledger import Ledger, carried_on, lineage_roots
from plumbline.operators.relational import for_each_row, scrub
from plumbline.plans import lineage as stored
from plumbline.streaming.pickup import Pickup, freshness_of_batches

T = dt.datetime


def written(rows, schema, spark, folder, sizes):
    """Rows in files of given sizes, in order."""
    at = 0
    for i, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}.parquet")
        at += n
    return spark.read.parquet(*[f"{folder}/{i}.parquet" for i in range(len(sizes))])


@pytest.mark.parametrize("sizes", [(40,), (3, 30, 7), (20, 1, 19)])
def test_row_numbers_do_not_depend_on_files(spark, tmp_path, sizes):
    df = written([(i % 13, "N/A" if i % 13 == 5 else str(i)) for i in range(40)], "k int, v string", spark, str(tmp_path), sizes)
    assert {r.k: (r.rows, r["first"]) for r in repeated_keys(df, ["k"]).collect()} == {0: (4, 1), 1: (3, 2), 2: (3, 3), 3: (3, 4), 4: (3, 5)}
    assert [(r.value, r.rows, r["first"]) for r in unread_values(df, "v", "int").collect()] == [("N/A", 3, 6)]
    found = check_table(df, [Unique(columns=["k"]), AllowedValues(allowed={"k": "0..11"})])
    assert "(1, 14, 27, ...)" in found.failures[0] and "row 13 (k 12); row 26 (k 12); row 39 (k 12)" in found.failures[1]
    some = check_table(df.where("k <> 0"), [AllowedValues(allowed={"k": "0..11"})])  # rows of the table at hand, not of the file
    assert "row 12 (k 12); row 24 (k 12)" in some.failures[0]


@pytest.mark.parametrize("sizes", [(60, 5), (5, 60), (20, 45)])
def test_a_busy_date_keeps_its_last_rows_in_the_order_of_the_table(spark, tmp_path, sizes):
    rows = [(dt.date(2026, 1, 5) + dt.timedelta(days=7 * w), 100.0 if i < 6 else 50.0 + w) for w in range(6) for i in range(10)] + [(dt.date(2026, 2, 16), 7.0)] * 5
    df = written(rows, "day date, x double", spark, str(tmp_path), sizes)
    found = detect_anomalies(df, "day", ["x"], last=4, only_latest=True).table.where("day = date'2026-02-16'").first()
    lone = detect_anomalies(df.where("x < 99").coalesce(1), "day", ["x"], last=4, only_latest=True).table.where("day = date'2026-02-16'").first()
    assert found.x_expected == lone.x_expected


def test_made_rows_have_places_of_their_own(spark, tmp_path):
    """Rows that explode made of one row of a file come in the order it made them, however the table is cut afterwards."""
    days = [(dt.date(2026, 1, 5) + dt.timedelta(days=7 * w), [float(i) for i in range(20)]) for w in range(2)]
    stored = written(days, "day date, xs array<double>", spark, str(tmp_path), (2,))
    made = stored.select("day", F.explode("xs").alias("x"))
    for table in (made, made.where("x >= 0"), made.unionByName(made.limit(0))):
        found = detect_anomalies(table, "day", ["x"], last=4, only_latest=False).table.where("day = date'2026-01-12'")
        assert {r.x_expected for r in found.collect()} == {17.5}
    with pytest.raises(OperatorError, match="order_by"):
        with_row_number(made)
    assert sorted(r.row_number for r in with_row_number(stored).collect()) == [1, 2]
    assert sorted(r.row_number for r in with_row_number(stored.where("day > date'2026-01-06'")).collect()) == [1]


def test_json_records_keep_their_names(spark):
    text = '[{"AVOIDED": 1, "DECIMAL(3,0)": 1.5, "a`b": null, "q: x": {"VOID": [1]}, "big": 123456789012345678901234}]'
    row = records_to_table(spark.createDataFrame([(text,)], "r string"), "r").first()
    assert (row.AVOIDED, row["DECIMAL(3,0)"], row["a`b"], row["q: x"].VOID, int(row.big)) == (1, 1.5, None, [1], 123456789012345678901234)


def test_a_query_per_row_takes_texts_and_names_as_they_are(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "oid int, orders string")
    items = spark.createDataFrame([(1,), (2,)], "k int")
    found = for_each_row(spark, items, "select 'orders' as kind, orders.oid, orders.orders from orders where orders.oid = item.k", {"orders": orders}, ["k"])
    assert [(r.item_index, r.kind, r.oid, r.orders) for r in found.orderBy("k").collect()] == [(1, "orders", 1, "a"), (2, "orders", 2, "b")]


def test_shifts_keep_the_time_of_day(spark):
    one = spark.createDataFrame([(dt.date(2024, 5, 17), T(2024, 5, 17, 10, 11, 12))], "d date, t timestamp_ntz")
    for fn, day in ((lambda c: X.shift_days(c, 3), 20), (lambda c: X.shift_weeks(c, -1), 10), (X.start_of_month, 1), (X.end_of_month, 31), (X.start_of_week, 13)):
        r = one.select(fn(F.col("d")).alias("d"), fn(F.col("t")).alias("t")).first()
        assert r.d == dt.date(2024, 5, day) and r.t == T(2024, 5, day, 10, 11, 12)
    r = one.select(X.shift_months(F.col("d"), 9).alias("d"), X.shift_months(F.col("t"), 9).alias("t")).first()
    assert r.d == dt.date(2025, 2, 17) and r.t == T(2025, 2, 17, 10, 11, 12)
    value = lambda c: one.select(c).first()[0]
    assert value(X.floor_div(F.lit(1.0), F.lit(0.1))) == 9 and value(X.floor_div(F.lit(-7.5), F.lit(2.0))) == -4
    assert value(X.floor_div(F.lit(2**60 + 1), F.lit(1))) == 2**60 + 1 and value(X.floor_div(F.lit(-7), F.lit(2))) == -4


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    pick = random.Random(3)
    numbers = [2.675, 0.15, 0.25, 0.35, 1.005, -2.675, -0.5, 0.5, 1.5, 2.5, 1e300, -0.0, 0.0, 5e-324, 123456789.5, 2.0 ** 52 + 0.5, 1e15 + 0.5, 4503599627370495.5]
    numbers += [pick.randrange(-10 ** 7, 10 ** 7) / 10 ** pick.randrange(1, 6) for _ in range(2000)] + [(2 * pick.randrange(10 ** 6) + 1) / 2000 for _ in range(500)]
    for places in (0, 1, 2, 3, 5):
        df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.rounded(F.col("x"), places).alias("y"))
        assert [(r.x, r.y) for r in df.collect() if r.y != round(r.x, places)] == []
    assert spark.range(1).select(X.rounded(F.lit(15), -1, binary=False), X.rounded(F.lit(25.0), -1)).first() == (20, 20.0)


def test_floor_division_of_whole_numbers(spark):
    pairs = [(2 ** 63 - 1, 2), (-2 ** 63, 7), (2 ** 60 + 1, 1), (-7, 2), (7, -2), (-2 ** 63 + 1, -3), (0, 5), (2 ** 53 + 1, 3)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", X.floor_div(F.col("a"), F.col("b")).alias("q"))
    assert [r.q for r in df.collect()] == [a // b for a, b in pairs]
    small = spark.createDataFrame([(7, 2), (-7, 2)], "a int, b int").select(X.floor_div(F.col("a"), F.col("b").cast("smallint")).alias("q"))
    assert [r.q for r in small.collect()] == [3, -4]


def test_rounding_and_division_take_no_decimals(spark):
    """Both cost several times as much by wide decimals; numbers next to a half, of every size, come out as round() has them."""
    import math
    import random

    pick = random.Random(5)
    near = [(2 * pick.randrange(10 ** pick.randrange(1, 15)) + 1) / 2 / 10 ** pick.randrange(0, 13) for _ in range(3000)]
    numbers = [s * y for x in near for y in (x, math.nextafter(x, 0), math.nextafter(x, 1e300)) for s in (1, -1)]
    numbers += [pick.uniform(-1, 1) * 10.0 ** pick.randrange(-20, 16) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for places in (0, 1, 2, 4, 8, 11, 12, 15):
        rows = df.select("x", X.rounded(F.col("x"), places).alias("y")).collect()
        assert [(r.x, r.y) for r in rows if r.y != round(r.x, places)] == []
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(X.rounded(F.col("x"), 2)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] == math.inf and odd[2][0] is None
    plan = spark.range(1).select(X.floor_div(F.col("id") + 2 ** 62, F.col("id") - 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan


def test_secrets_by_index_are_hidden_as_by_folding(spark):
    import random

    pick = random.Random(4)
    letters = "ab*/ é\"'\\%"
    secrets = ["".join(pick.choice(letters) for _ in range(pick.randrange(2, 9))) for _ in range(60)] + ["x***", "***y", "****"]
    texts = ["".join(pick.choice(letters + "xy") for _ in range(60)) + pick.choice(secrets) + "y" + pick.choice(secrets) for _ in range(200)] + [None, "", "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert scrub(df, secrets, folded=0).collect() == scrub(df, secrets, folded=10 ** 6).collect()


def test_a_hundred_thousand_secrets(spark):
    import time

    secrets = [f"{i * 7919 % 100_003:06d}-key" for i in range(100_000)]
    df = spark.range(20_000).selectExpr("id", "concat('a clean text of some length, number ', id, if(id % 1000 = 7, ' 000042-key here', '')) as t").cache()
    df.count()
    made = scrub(df, secrets)
    started = time.time()
    assert made.where("t like '%*** here'").count() == 20 and made.where("t like '%-key%'").count() == 0
    assert time.time() - started < 60


def test_a_thousand_secrets(spark):
    secrets = [f"s/{i:04d} ä\"x" for i in range(1000)]
    df = spark.createDataFrame([(f"a {secrets[7]} b s%2F0009%20%C3%A4%22x c s/0011 \\u00e4\\\"x d",), (None,)], "t string")
    assert [r.t for r in scrub(df, secrets).collect()] == ["a *** b *** c *** d", None]


def test_backslashes_end_no_text_in_standard_sql():
    assert with_literals("p = 'C:\\' and d = :day and x = 'y' -- :no\n", {"day": dt.date(2026, 1, 2)}) == "p = 'C:\\' and d = DATE '2026-01-02' and x = 'y' -- :no\n"


def test_circles_are_named_and_leave_other_chains_alone(spark):
    links = [(i + 1, i) for i in range(1, 40)] + [(101, 103), (102, 101), (103, 102), (104, 103)]
    lineage = spark.createDataFrame(links, "run_id long, carried_on_from long")
    with pytest.raises(OperatorError, match="circle.*101, 102, 103, 104"):
        lineage_roots(lineage).collect()
    assert {r.run_id for r in carried_on(lineage, 20).collect()} == set(range(21, 41))
    assert {r.run_id for r in carried_on(lineage, 101).collect()} == {102, 103, 104}
    good = lineage.where("run_id < 100")
    assert {(r.run_id, r.root, r.depth) for r in lineage_roots(good).collect()} == {(i + 1, 1, i) for i in range(1, 40)}


def test_two_pickups_in_one_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    for flow in ("one", "two"):
        spark.range(3 if flow == "one" else 5).write.parquet(f"{tmp_path}/{flow}/in")
        Pickup(spark, f"{tmp_path}/{flow}/in", "id long", f"{tmp_path}/{flow}/state", [Unique(columns=["id"])], f"{tmp_path}/{flow}/out", ledger=ledger, flow=flow).run()
    runs = ledger.state("runs")
    assert {r.flow for r in runs.collect()} == {"one", "two"} and runs.select("run_id").distinct().count() == 2
    assert {(r.flow, r["rows"]) for r in freshness_of_batches(ledger).collect()} == {("one", 3), ("two", 5)}
    mine = next(r for r in runs.collect() if r.flow == "two")
    assert ledger.run_number("two", mine.params) == mine.run_id and ledger.run_number("two", "else") == 2


def test_all_broken_files_are_there(spark):
    files = spark.range(250).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(0).cast("bigint").alias("size"), F.lit(T(2026, 1, 1)).alias("modified"))
    found = check_files(files, not_empty=True, minimum="1 KB")
    assert not found.passed and found.broken.count() == 500 and "and 150 more" in found.failures[0]


def test_stored_steps(spark, monkeypatch):
    kept = stored.cut(spark.range(5))
    assert kept.count() == 5 and stored.forget_stored(spark) >= 1 and not stored._STORED

    class Context:
        master = "spark://there:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(OperatorError, match="spark.checkpoint.dir"):
        stored.checkpoint_dir(Session())
