import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import (AllowedValues, ColumnTypes, Conditions, EarlierRun, Freshness, NoMissing, OperatorError, RowCount,
                       RowCountCompared, Unique, check_table, repeated_keys, unread_values)

ORDERS = [(1, 101, "2026-10-01", "north", 10.0), (2, 102, "2026-10-01", "south", 20.0), (3, 103, "2026-10-02", "north", None),
          (4, 104, "2026-10-02", "east", 40.0), (5, 105, "2026-10-03", "", 50.0), (6, 105, "2026-10-03", "south", None),
          (7, 107, "bad", "north", -7.0), (8, 105, None, "north", 80.0), (9, 109, "2026-10-04", None, 90.5),
          (10, 102, "2026-1-5", "south", 100.0)]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(ORDERS, "row bigint, order_id bigint, day string, region string, amount double")


def one(df, check):
    return check_table(df, [check], row="row" if "row" in df.columns else None).outcomes[0][1:]


def test_row_count(orders):
    assert one(orders, RowCount(at_least=1)) == ("passed", None, "10 rows (at least 1)")
    assert one(orders, RowCount(at_least=11)) == ("failed", None, "10 rows; it must have at least 11")
    assert one(orders, RowCount(at_most=9, if_fails="warn")) == ("warned", None, "10 rows; it may have at most 9")


def test_compared(orders):
    assert one(orders, RowCountCompared())[::2] == ("passed", "10 rows; no earlier successful run: nothing to compare with yet")
    assert one(orders, RowCountCompared(earlier=EarlierRun(3, 8)))[2] == "10 rows, 25% more than the 8 rows of run #3 (within 30%)"
    assert one(orders, RowCountCompared(earlier=EarlierRun(3, 10)))[0] == "passed"
    assert one(orders, RowCountCompared(earlier=EarlierRun(3, 0)))[0] == "failed"
    assert one(orders, RowCountCompared(earlier=EarlierRun(3, None), if_fails="warn"))[0] == "failed"


def test_missing(orders):
    assert one(orders, NoMissing(columns=["amount"])) == (
        "failed", 2, "amount has 2 gaps, 0 may be: row 3 (amount missing); row 6 (amount missing)")
    assert one(orders, NoMissing(columns=["amount"], allowed="20%"))[0] == "passed"
    assert one(orders, NoMissing(columns=["region", "amount", "day"], allowed="1"))[1] == 2
    assert one(orders, NoMissing(columns=["region"], empty_text=True))[1] == 2
    assert one(orders, NoMissing())[1] == 4
    assert "not a column" in one(orders, NoMissing(columns=["nope"], if_fails="warn"))[2]
    assert one(orders, NoMissing(columns=["nope"], if_fails="warn"))[0] == "failed"


def test_unique(orders):
    assert one(orders, Unique(columns=["row"])) == ("passed", 0, "no two rows share row")
    assert one(orders, Unique(columns=["order_id"])) == (
        "failed", 5, "5 rows share order_id with others: order_id 102 has 2 rows (2, 10); order_id 105 has 3 rows (5, 6, 8)")
    assert one(orders, Unique(columns=["day", "region"]))[1] == 0


def test_many_repeats(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("row"), (F.col("id") % 7).alias("k"))
    details = one(df, Unique(columns=["k"]))[2]
    assert details.startswith("1,000 rows share k with others: k 1 has 143 rows (1, 8, 15, ...); k 2 has 143 rows") and details.endswith("; and 2 more")
    assert [r["k"] for r in repeated_keys(df, ["k"], "row").collect()] == [1, 2, 3, 4, 5]


def test_types(orders):
    assert one(orders, ColumnTypes(types={"order_id": "float", "region": "text", "amount": ""}))[0] == "passed"
    assert one(orders, ColumnTypes(types={"day": "date"})) == (
        "failed", 2, "day is text, and 2 rows have a value that does not read as date: 'bad' (1 row, the first row 7), "
                     "'2026-1-5' (1 row, the first row 10)")
    assert one(orders, ColumnTypes(types={"amount": "int", "gone": "text"}))[2] == "amount is float, not int; gone is not in the table"
    assert unread_values(orders, "day", "date", "row").count() == 2


def test_values(orders):
    assert one(orders, AllowedValues(allowed={"amount": "0..95"})) == (
        "failed", 2, "amount: 2 rows not within 0..95: row 7 (amount -7.0); row 10 (amount 100.0)")
    assert one(orders, AllowedValues(allowed={"region": "north, south"}))[1] == 2
    assert one(orders, AllowedValues(allowed={"day": "2026-10-02.."}))[1] == 4
    assert one(orders, AllowedValues(allowed={"amount": "0..x"}))[0] == "failed"
    assert "has no ends" in one(orders, AllowedValues(allowed={"amount": ".."}))[2]
    assert one(orders, AllowedValues(allowed={"order_id": "100..200", "amount": "..1e3"}))[0] == "passed"


def test_freshness(spark, orders):
    assert one(orders, Freshness(column="day"))[2].startswith("day is text, and 2 rows do not read as a date (YYYY-MM-DD): row 7")
    good = orders.where("row < 7")
    now = dt.datetime(2026, 10, 4, 8)
    assert check_table(good, [Freshness(column="day")], row="row", now=now).passed
    late = check_table(good, [Freshness(column="day")], row="row", now=now + dt.timedelta(days=1))
    assert late.outcomes[0][3] == "the latest day is 2026-10-03, before 2026-10-04"
    assert check_table(good, [Freshness(column="day", at_least="date'2026-10-01' + 1")], row="row").passed
    assert not check_table(good, [Freshness(column="day", at_least="1 + 1", if_fails="warn")], row="row").passed
    stamped = good.withColumn("at", F.to_timestamp(F.lit("2026-10-03 10:00:00")))
    assert check_table(stamped, [Freshness(column="at", at_least=dt.datetime(2026, 10, 3, 10))], row="row").passed
    assert not check_table(stamped, [Freshness(column="at", at_least=lambda today, now: dt.datetime(2026, 10, 3, 10, 1))], row="row").passed


def test_conditions(orders):
    assert one(orders, Conditions(rules=["amount >= 0", "amount is null or amount < 1000"])) == (
        "failed", 3, "amount >= 0: 3 rows break it: row 3 (amount missing); row 6 (amount missing); row 7 (amount -7.0)")
    broken = one(orders, Conditions(rules=["amount >=", "row > 0"], if_fails="warn"))
    assert broken[0] == "failed" and "is not a condition Spark can check" in broken[2]


def test_condition_that_fails_on_a_row(orders):
    """The other checks are still made when one condition cannot be worked out on some row."""
    found = check_table(orders, [RowCount(at_least=1), Conditions(rules=["cast(region as int) > 0"], if_fails="warn")], row="row")
    assert [o[1] for o in found.outcomes] == ["passed", "failed"]


def test_result_and_table(orders):
    good = check_table(orders, [RowCount(at_least=1), NoMissing(columns=["amount"], if_fails="warn")], row="row")
    assert good.passed and good.require() is orders
    assert [(r.check, r.outcome) for r in good.results.collect()] == [("Row count", "passed"), ("No missing values", "warned")]
    bad = check_table(orders, [RowCount(at_least=100)], row="row")
    with pytest.raises(OperatorError, match="must have at least 100") as e:
        bad.require()
    assert e.value.results.count() == 1 and bad.table is None


@pytest.mark.parametrize("check", [RowCount(), NoMissing(allowed="many"), Unique(), ColumnTypes(), ColumnTypes(types={"a": "number"}),
                                   AllowedValues(allowed={"a": " "}), Freshness(), Conditions(), RowCount(at_least=1, if_fails="stop")])
def test_set_up_wrong(orders, check):
    with pytest.raises(OperatorError):
        check_table(orders, [check])


def test_no_checks(orders):
    with pytest.raises(OperatorError, match="at least one check"):
        check_table(orders, [])


def test_one_pass_for_all_passing_checks(spark, orders):
    """Passing checks cost one job, whatever their number."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checks", "checks")
    check_table(orders, [RowCount(at_least=1), NoMissing(columns=["row"]), AllowedValues(allowed={"row": "0..100"}),
                         Conditions(rules=["row > 0", "order_id > 0"])], row="row")
    jobs = len(tracker.getJobIdsForGroup("checks"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 2  # (an aggregate is a map job and a result job under adaptive execution)
