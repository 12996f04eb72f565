"""Queries run in a database and read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col
from ..functions.params import with_literals
from ..operators.sql import dedupe_columns

FETCH_SIZE = 50_000
_WHOLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def query_options(url: str, sql: str, params: dict | None = None, values: dict | None = None,
                  fetch_size: int = FETCH_SIZE, partition: dict | None = None, **props) -> dict:
    """The options spark.read takes. `values` are further binds and win over `params`. A database gets no binds through
    Spark, so each is written in as a literal. `partition`: column, lower, upper, count: that many tasks read it."""
    text = with_literals(sql.strip().rstrip(";").strip(), {**(params or {}), **(values or {})})
    options = {"url": url, "fetchsize": str(fetch_size), "preferTimestampNTZ": "true", **props}
    if partition is None:
        return {**options, "query": text}
    gone = [k for k in ("column", "lower", "upper", "count") if k not in partition]
    if gone:
        raise OperatorError(f"partition: {', '.join(gone)} is missing")
    return {**options, "dbtable": f"({text}) t", "partitionColumn": str(partition["column"]),
            "lowerBound": str(partition["lower"]), "upperBound": str(partition["upper"]),
            "numPartitions": str(partition["count"])}


def read_query(spark: SparkSession, url: str, sql: str, params: dict | None = None, values: dict | None = None,
               fetch_size: int = FETCH_SIZE, partition: dict | None = None, **props) -> DataFrame:
    """A query's rows. It runs whole in the database; an empty result keeps its columns."""
    options = query_options(url, sql, params, values, fetch_size, partition, **props)
    return normalise_jdbc_types(dedupe_columns(spark.read.format("jdbc").options(**options).load()))


def normalise_jdbc_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, other binary numbers as double, times without zone, binary values as hex text, and
    anything that is no plain type as text; a decimal, date, boolean or text stays as it is."""
    made = []
    for f in df.schema:
        c, t = col(f.name), f.dataType
        if isinstance(t, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(t, _WHOLE) and not isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif not isinstance(t, (T.BooleanType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampNTZType, T.StringType)):
            c = c.cast("string")
        made.append(c.alias(f.name))
    return df.select(*made)
