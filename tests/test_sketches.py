"""Estimates from merged sketches against exact statistics."""

import pytest
from pyspark.sql import functions as F

from plumbline import OperatorError, profile
from plumbline.operators.sketches import WHOLE_ROW, SketchStore, estimates, merge_sketches, sketch


def table(spark, first, n):
    return spark.range(first, first + n).selectExpr("id", "(id * 7919) % 1000 as k", "if(id % 10 = 0, null, (id * 104729) % 100003 / 7.0D) as x",
                                                     "concat('name ', id % 321) as name", "cast(id % 50 as decimal(8, 2)) as d", "id % 2 = 0 as even")


def near(found, df):
    """Counts exact, distinct values within 6 %, percentiles within 2 % of the rows."""
    exact = {r.column: r for r in profile(df).stats.collect()}
    rows = df.count()
    for r in found:
        if r.column == WHOLE_ROW:
            assert r.rows == rows and abs(r.distinct - df.distinct().count()) <= 0.06 * rows
            continue
        e = exact[r.column]
        assert (r["count"], r.missing) == (e["count"], e.missing) and abs(r.distinct - e.distinct) <= max(1, 0.06 * e.distinct), r.column
        if r.median is not None:
            assert float(r.min) == float(e.min) and float(r.max) == float(e.max)
            for name, share in (("25%", 0.25), ("median", 0.5), ("75%", 0.75)):
                below, upto = df.agg(F.count_if(F.col(r.column) < r[name]), F.count_if(F.col(r.column) <= r[name])).first()
                assert below - 0.02 * rows <= share * e["count"] <= upto + 0.02 * rows, (r.column, name)


def test_merged_parts(spark):
    df = table(spark, 0, 20_000).withColumn("part", F.col("id") % 7)
    parts = sketch(df, by=["part"])
    assert parts.count() == 7 * 7
    near(estimates(parts).collect(), df.drop("part"))
    for p in (0, 3):
        near([r for r in estimates(parts, ["part"]).collect() if r.part == p], df.where(F.col("part") == p).drop("part"))
    twice = merge_sketches(parts.unionByName(sketch(df, by=["part"])))
    found = {r.column: r for r in estimates(twice).collect()}
    assert found["id"].rows == 40_000 and abs(found["id"].distinct - 20_000) < 1200 and abs(found[WHOLE_ROW].missing - 20_000) < 1200


def test_a_grown_table_costs_its_new_file(spark, tmp_path):
    folder, store = str(tmp_path / "data of a day"), SketchStore(spark, str(tmp_path / "sketches"))
    with pytest.raises(OperatorError, match="no sketches"):
        store.parts()
    table(spark, 0, 5000).coalesce(1).write.parquet(folder)
    [first] = store.add_files(folder)
    assert store.add_files(folder) == []
    table(spark, 5000, 5000).coalesce(1).write.mode("append").parquet(folder)
    read = []
    with pytest.MonkeyPatch.context() as patch:
        from plumbline.operators import sketches

        patch.setattr(sketches, "sketch", lambda rows, *a: read.extend(map(sketches._plain, rows.inputFiles())) or sketch(rows, *a))
        [second] = store.add_files(folder)
    assert read == [second] and second != first
    near(store.estimates().collect(), table(spark, 0, 10_000))
    store.forget_files([first])
    near(store.estimates().collect(), table(spark, 5000, 5000))


def test_odd_tables(spark):
    empty = estimates(sketch(table(spark, 0, 0))).collect()
    assert all(r.rows == 0 and r["count"] == 0 and r.distinct == 0 for r in empty) or empty == []
    nulls = {r.column: r for r in estimates(sketch(spark.range(10).selectExpr("cast(null as double) as x", "array(id) as a", "map('k', id) as m"))).collect()}
    assert nulls["x"].missing == 10 and nulls["x"].distinct == 0 and nulls["x"].median is None and nulls["a"].distinct == 10 and nulls["m"].distinct == 10
    with pytest.raises(OperatorError, match="NaN"):
        sketch(spark.createDataFrame([(float("nan"),)], "x double"))
