"""Column kinds: the coarse types settings and messages speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import OperatorError

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
BINARY_FLOAT = (T.FloatType, T.DoubleType)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def kind_of(dtype: T.DataType) -> str:
    """text, int, float (any number that is not whole), bool, date or datetime; else Spark's name for the type."""
    if isinstance(dtype, TEXT):
        return "text"
    if isinstance(dtype, WHOLE):
        return "int"
    if isinstance(dtype, (*BINARY_FLOAT, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dtype.typeName()


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema}


def family(dtype: T.DataType) -> str | None:
    """number, text or date: which statistics a column gets. None: counts and extremes only."""
    kind = kind_of(dtype)
    return {"int": "number", "float": "number", "text": "text", "date": "date", "datetime": "date"}.get(kind)


def col(name: str) -> Column:
    """A column by its literal name: dots and backticks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def need_columns(df: DataFrame, names, setting: str) -> None:
    """Refuse names the table does not have, listing the ones it has."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        verb = "is not a column" if len(unknown) == 1 else "are not columns"
        raise OperatorError(f"{setting}: {', '.join(unknown)} {verb} of the table (its columns: {', '.join(df.columns)})")


def refuse_names(df: DataFrame, names, why: str) -> None:
    """Refuse a table that already has one of the columns an operator is about to add."""
    taken = [n for n in names if n in df.columns]
    if taken:
        raise OperatorError(f"the table already has {', '.join(taken)}, which {why}: rename it first")


def unique_names(names) -> list[str]:
    return list(dict.fromkeys(names))


def rows_text(n: int) -> str:
    return f"{n:,} row" + ("" if n == 1 else "s")


def shown(value) -> str:
    """A value as a message shows it: text quoted and cut at 60 characters, a null as missing."""
    if value is None:
        return "missing"
    if isinstance(value, str):
        return repr(value[:60] + "..." if len(value) > 60 else value)
    return str(value)
