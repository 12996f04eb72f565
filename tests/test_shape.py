"""What is held does not grow with the rows: ten times the rows leave the driver's process, in which the tasks run here, as it was."""

import resource

from pyspark.sql import functions as F

from plumbline import AllowedValues, Conditions, NoMissing, RowCount, Unique, check_table, profile


def table(spark, n):
    return spark.range(n).select("id", (F.col("id") % 1000).alias("k"), (F.col("id") * 7919 % 100_003 / 7.0).alias("x"), F.concat(F.lit("name "), F.col("id") % 321).alias("name"))


def held(spark):
    """MB that the JVM holds after its garbage is gone, and the most that Python has held."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    for _ in range(3):
        spark._jvm.System.gc()
    return (runtime.totalMemory() - runtime.freeMemory()) / 1e6, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def growth(spark, work):
    work(100_000)  # (classes and code are loaded)
    work(500_000)
    before = held(spark)
    work(5_000_000)
    return [after - was for was, after in zip(before, held(spark))]


def test_checks(spark):
    checks = [RowCount(at_least=1), NoMissing(columns=["x", "name"]), AllowedValues(allowed={"k": "0..999"}), Conditions(rules=["x >= 0"]), Unique(columns=["id"])]

    def work(n):
        assert check_table(table(spark, n), checks, row="id").passed

    assert max(growth(spark, work)) < 250


def test_estimated_statistics(spark):
    def work(n):
        found = {r.column: r for r in profile(table(spark, n), exact=False).stats.collect()}
        assert found["id"]["count"] == n

    assert max(growth(spark, work)) < 80


def test_exact_statistics_of_many_rows(spark):
    found = {r.column: r for r in profile(spark.range(3_000_000).selectExpr("id", "cast(id % 7 as double) as x"), parts=("numbers",)).stats.collect()}
    assert (found["id"]["25%"], found["id"].median, found["id"]["75%"], found["id"].distinct) == (749_999.75, 1_499_999.5, 2_249_999.25, 3_000_000)
    assert (found["x"].median, found["x"].distinct, found["x"].zeros) == (3.0, 7, 428_572)
