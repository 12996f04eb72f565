"""SQL and functions over named input tables."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import OperatorError
from ..functions.params import bind


_NAMING = threading.RLock()  # the inputs' names are the session's while a query is read: one query at a time


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Columns of one name told apart: id, id_1, id_2. (Spark cannot write two columns of one name.)"""
    taken = Counter(c.lower() for c in df.columns)
    if max(taken.values(), default=0) < 2:
        return df
    used, names = set(), []
    for c in df.columns:
        name, i = c, 0
        while name.lower() in used or (i and name.lower() in taken):
            i += 1
            name = f"{c}_{i}"
        used.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def run_sql(spark: SparkSession, sql: str, inputs: dict[str, DataFrame] | DataFrame, params: dict | None = None) -> DataFrame:
    """One query over input tables under their names (a lone table is `input`), with :name parameters; lists bind one
    value per item. The result is lazy."""
    if isinstance(inputs, DataFrame):
        inputs = {"input": inputs}
    text, args = bind(sql.strip().rstrip(";").strip(), params or {})
    with _NAMING:
        views = {}
        try:
            for name, df in inputs.items():
                if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
                    views[name] = spark.table(name)  # (put back afterwards)
                else:
                    views[name] = None
                df.createOrReplaceTempView(name)
            try:
                found = spark.sql(text, args=args) if args else spark.sql(text)
            except ParseException as e:
                raise OperatorError(f"the SQL cannot be read: {str(e).splitlines()[0]}") from None
            if not found.columns:
                raise OperatorError("the SQL must end with a query that gives a table, e.g. select * from ...")
        finally:
            for name, earlier in views.items():
                spark.catalog.dropTempView(name)
                if earlier is not None:
                    earlier.createOrReplaceTempView(name)
    return dedupe_columns(found)


def transform(df: DataFrame, fn, params: dict | None = None) -> DataFrame:
    """A function of the table (and the parameters, if it takes two) that gives the new table."""
    made = fn(df, params) if params is not None else fn(df)
    if not isinstance(made, DataFrame):
        raise OperatorError(f"the function must give a DataFrame, got {type(made).__name__}")
    return made


def source_names(sources: list[tuple[str, str]]) -> list[str]:
    """Names for several sources of one input: the step, step_output where that is taken, then step_output_2..."""
    names: list[str] = []
    for step, output in sources:
        choices = (step, f"{step}_{output}", *(f"{step}_{output}_{i}" for i in range(2, len(sources) + 2)))
        names.append(next(n for n in choices if n not in names))
    return names
