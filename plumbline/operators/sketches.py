"""Estimated statistics from sketches that are stored by part of a table and merged without reading its rows again.

A part is what a table grows by: a file, a day. For each part and column one row holds the counts, the least and greatest
value, and two sketches: one of the distinct values (HyperLogLog) and, for numbers, one of their order (KLL). Sums, extremes
and sketches of parts add up to those of any set of parts, so a table that has grown by a file costs that file. The row
named by WHOLE_ROW is of the rows as such: its distinct values are the different rows.

How far estimates lie off: distinct values by some 1.6 % (a standard deviation, 2^-0.5 K at 2^12 registers), a percentile's
rank by under 1 % of the rows. A column of NaN or infinite values has no order, and is refused when its part is sketched."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import OperatorError
from ..functions.kinds import BINARY_FLOAT, col, family, need_columns, unique_names
from ..sources.commits import commit_table, read_committed, versions
from ..sources.files import escape_glob
from .profile import PERCENTILES, comparable_rows, nonfinite_counts, refuse_nonfinite, value_text

WHOLE_ROW = "*"
REGISTERS = 12  # of the sketch of distinct values: 2^12
ACCURACY = 400  # of the sketch of the order
FILE = "file"


def sketch(df: DataFrame, columns=None, by=(), check: bool = True) -> DataFrame:
    """A row per part (the `by` columns) and column: by, column, type, rows, count, least, greatest, distinct_sketch and
    order_sketch (null but for numbers). One pass over the rows; what is shuffled is a few KB for each part and column."""
    by, picked = unique_names(by), unique_names(columns or [c for c in df.columns if c not in by])
    need_columns(df, [*picked, *by], "Sketch")
    types = {f.name: f.dataType for f in df.schema}
    floats = [c for c in picked if isinstance(types[c], BINARY_FLOAT)]
    if check and floats:
        refuse_nonfinite(df.agg(*nonfinite_counts(df, floats)).first().asDict(), floats)
    whole = comparable_rows(df.select(*[col(c) for c in df.columns if c not in by], *[col(b) for b in by]))
    row = F.xxhash64(*[F.coalesce(value_text(f.name, f.dataType), F.lit("\u0001null")) for f in whole.schema if f.name not in by])
    measures, cells = [F.count("*").alias("rows"), F.hll_sketch_agg(row, REGISTERS).alias("row_sketch")], []
    for i, c in enumerate(picked):
        number, text = family(types[c]) == "number", value_text(c, whole.schema[c].dataType)
        measures += [F.count(col(c)).alias(f"n{i}"), F.hll_sketch_agg(text, REGISTERS).alias(f"d{i}"), F.min(col(c).cast("double") if number else text).cast("string").alias(f"lo{i}"),
                     F.max(col(c).cast("double") if number else text).cast("string").alias(f"hi{i}")]
        if number:
            measures.append(F.kll_sketch_agg_double(col(c).cast("double"), ACCURACY).alias(f"q{i}"))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("type"), F.col(f"n{i}").alias("count"), F.col(f"lo{i}").alias("least"),
                              F.col(f"hi{i}").alias("greatest"), F.col(f"d{i}").alias("distinct_sketch"),
                              F.when(F.col(f"n{i}") > 0, F.col(f"q{i}") if number else F.lit(None).cast("binary")).alias("order_sketch")))
    none = [F.lit(None).cast("string").alias(n) for n in ("least", "greatest")]
    cells.append(F.struct(F.lit(WHOLE_ROW).alias("column"), F.lit("row").alias("type"), F.col("rows").alias("count"), *none,
                          F.col("row_sketch").alias("distinct_sketch"), F.lit(None).cast("binary").alias("order_sketch")))
    made = whole.groupBy(*[col(b) for b in by]).agg(*measures)
    return made.select(*[col(b) for b in by], "rows", F.explode(F.array(*cells)).alias("c")).select(*[col(b) for b in by], "rows", "c.*")


def merge_sketches(parts: DataFrame, by=()) -> DataFrame:
    """The sketches of all parts together, or of those of each `by` value (columns of `parts`)."""
    keys = [*[col(b) for b in unique_names(by)], "column", "type"]
    text = ~F.col("order_sketch").isNotNull()
    number = lambda c: F.when(~text, F.col(c).cast("double"))
    made = parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"),
        F.coalesce(F.min(number("least")).cast("string"), F.min(F.when(text, F.col("least")))).alias("least"),
        F.coalesce(F.max(number("greatest")).cast("string"), F.max(F.when(text, F.col("greatest")))).alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("order_sketch", ACCURACY).alias("order_sketch"),
        F.count("order_sketch").alias("__ordered"))
    return made.withColumn("order_sketch", F.when(F.col("__ordered") > 0, F.col("order_sketch"))).drop("__ordered")


def estimates(parts: DataFrame, by=()) -> DataFrame:
    """A row per column (and `by` value): column, type, rows, count, missing, distinct, min, 25%, median, 75%, max; the row of
    WHOLE_ROW tells of the rows: distinct is how many different ones there are, missing how many repeat another."""
    found = merge_sketches(parts, by)
    distinct = F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("count"))
    at = {name: F.when(F.col("order_sketch").isNotNull(), F.kll_sketch_get_quantile_double("order_sketch", F.lit(share))) for name, share in PERCENTILES.items()}
    whole = F.col("column") == WHOLE_ROW
    return found.select(*[col(b) for b in unique_names(by)], "column", "type", "rows", "count",
                        F.when(whole, F.col("rows") - distinct).otherwise(F.col("rows") - F.col("count")).alias("missing"), distinct.alias("distinct"),
                        F.col("least").alias("min"), *[c.alias(n) for n, c in at.items()], F.col("greatest").alias("max"))


def _plain(file: str) -> str:
    """A file's name in one writing: Spark has file:///a%20b and file:/a b for the same."""
    return re.sub(r"^(\w+):///", r"\1:/", unquote(file))


class SketchStore:
    """The sketches of a growing table of Parquet files, in a committed table at `path`."""

    def __init__(self, spark: SparkSession, path: str, columns=None):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns

    def parts(self) -> DataFrame:
        if not versions(self.spark, self.path):
            raise OperatorError(f"{self.path} holds no sketches yet")
        return read_committed(self.spark, self.path)

    def add_files(self, folder: str) -> list[str]:
        """Sketch the files of a folder that have no sketches yet, and only them; their names. Files that are gone stay
        counted until `forget_files`."""
        there = {_plain(f) for f in self.spark.read.parquet(escape_glob(folder)).inputFiles()}
        before = (versions(self.spark, self.path) or [0])[-1]
        known = {_plain(r[0]) for r in self.parts().select(FILE).distinct().collect()} if before else set()  # (a name per file)
        new = sorted(there - known)
        if not new:
            return []
        rows = self.spark.read.parquet(*[escape_glob(f) for f in new]).withColumn(FILE, F.col("_metadata.file_path"))
        made = sketch(rows, self.columns, [FILE])
        commit_table(self.parts().unionByName(made) if before else made, self.path, expected=before)
        return new

    def forget_files(self, names) -> None:
        before = versions(self.spark, self.path)[-1]
        gone = [r[0] for r in self.parts().select(FILE).distinct().collect() if _plain(r[0]) in names]
        commit_table(self.parts().where(~F.col(FILE).isin(*gone)), self.path, expected=before)

    def estimates(self) -> DataFrame:
        return estimates(self.parts())
