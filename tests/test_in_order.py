"""Whole groups in order in Python, against plain loops."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import OperatorError
from plumbline.operators.python_code import in_order

BATCH = 100


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    yield
    spark.conf.set(key, before)


def balance():
    """A running sum, and how many rows a batch had."""
    def step(state, frame):
        sums = state + frame["x"].cumsum()
        return int(sums.iloc[-1]), pd.DataFrame({"id": frame["id"], "upto": sums, "held": len(frame)})

    return step


def groups(spark, n):
    """Half of the rows in one group; a group without a name."""
    name = F.when(F.col("id") % 2 == 0, "big").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 11))
    return spark.range(n).select("id", name.alias("g"), (F.col("id") * 37 % 101 - 50).alias("x")).repartition(5, F.col("id") * 7 % 5)


@pytest.mark.parametrize("rows", [None, 700])
def test_running_sums(spark, small_batches, rows):
    df = groups(spark, 6000)
    more = {} if rows is None else {"combine": lambda a, b: a + b, "rows": rows}
    found = in_order(df, "g", "id", balance(), "id long, upto long, held long", start=lambda: 0, **more).collect()
    sums, wanted = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        sums[r.g] = sums.get(r.g, 0) + r.x
        wanted[r.id] = (r.g, sums[r.g])
    assert {r.id: (r.g, r.upto) for r in found} == wanted and len(found) == 6000
    assert max(r.held for r in found) <= BATCH  # (no step sees more than a batch)


def test_state_that_cannot_be_combined(spark, small_batches):
    """The longest run of rising values so far: a state of its own for each group."""
    def rising(state, frame):
        out = []
        for x in frame["x"]:
            state = (x, state[1] + 1 if state[0] is not None and x > state[0] else 1)
            out.append(state[1])
        return state, pd.DataFrame({"id": frame["id"], "run": out})

    df = groups(spark, 1000)
    found = {r.id: r.run for r in in_order(df, ["g"], ["id"], rising, "id long, run int", start=lambda: (None, 0)).collect()}
    last, wanted = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        x, n = last.get(r.g, (None, 0))
        last[r.g] = (r.x, n + 1 if x is not None and r.x > x else 1)
        wanted[r.id] = last[r.g][1]
    assert found == wanted


def test_only_groups_of_several_chunks_run_twice(spark):
    """3,000 groups of two rows in six chunks; results of unlike types (whole numbers beyond 2^53, missing) stay as they are."""
    calls = spark.sparkContext.accumulator(0)

    def step(state, frame):
        calls.add(1)
        state += len(frame)
        seen = [2 ** 60 + int(x) for x in frame["id"]] if frame["g"].iloc[0] % 3 else [None] * len(frame)
        return state, pd.DataFrame({"n": state, "seen": seen, "id": frame["id"]})

    df = spark.range(6000).select("id", (F.col("id") % 3000).alias("g")).repartition(3)
    found = in_order(df, "g", "id", step, "id long, n long, seen long", start=lambda: 0, combine=lambda a, b: a + b, rows=1000).collect()
    assert sorted(r.id for r in found) == list(range(6000))
    assert all(r.g == r.id % 3000 and r.seen == (2 ** 60 + r.id if r.g % 3 else None) for r in found)
    assert calls.value <= 3000 + 5 * 2


def test_without_groups_and_without_rows(spark, small_batches):
    df = spark.range(1000).selectExpr("id", "id as x")
    for more in ({}, {"combine": lambda a, b: a + b, "rows": 130}):
        found = in_order(df, [], "id", balance(), "id long, upto long, held long", start=lambda: 0, **more)
        assert {r.id: r.upto for r in found.collect()} == {i: i * (i + 1) // 2 for i in range(1000)}
        assert in_order(df.limit(0), [], "id", balance(), "id long, upto long, held long", start=lambda: 0, **more).count() == 0
    with pytest.raises(OperatorError, match="group column"):
        in_order(df.withColumn("g", F.lit(1)), "g", "id", balance(), "g long, upto long")
    with pytest.raises(OperatorError, match="nope"):
        in_order(df, "nope", "id", balance(), "upto long")
