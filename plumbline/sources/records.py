"""JSON records to rows and back."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col, need_columns


def table_to_records(df: DataFrame, name: str = "record") -> DataFrame:
    """An object per row, nulls included."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def records_to_table(df: DataFrame, json_column: str, keep=()) -> DataFrame:
    """A table of the records in a column of JSON lists of objects: a row per object, its columns those of any object.
    Each record's `keep` columns stay with it. A text that is no list, or a list with anything but objects, is an error.

    The schema comes from one distributed pass that merges what every record holds."""
    need_columns(df, [json_column, *keep], "JSON records")
    parsed = df.where(col(json_column).isNotNull()).withColumn("__v", F.try_parse_json(col(json_column)))
    listed = parsed.withColumn("__kind", F.schema_of_variant("__v"))
    schema, kind = F.schema_of_variant_agg("__v"), F.col("__kind")
    is_list = F.coalesce(F.startswith(kind, F.lit("ARRAY<")), F.lit(False))
    objects = F.startswith(kind, F.lit("ARRAY<OBJECT<")) | (kind == "ARRAY<VOID>")  # (that of an empty list, or of nulls)
    nulls = F.exists(F.when(is_list, F.col("__v").cast("array<variant>")), F.is_variant_null)
    facts = listed.agg(F.count_if(~is_list).alias("bad"), F.count_if(is_list & (~objects | nulls)).alias("odd"), schema.alias("schema")).first()
    if facts["bad"]:
        raise OperatorError(f"{json_column}: {facts['bad']:,} of its values are not a JSON list of records")
    if facts["odd"]:
        raise OperatorError(f"{json_column}: {facts['odd']:,} of its values have list items that are not objects")
    kept = [col(k) for k in keep]
    merged = (facts["schema"] or "").strip()
    if not merged.upper().startswith("ARRAY<OBJECT<") or merged.upper() == "ARRAY<OBJECT<>>":
        return df.select(*kept).limit(0)
    element, _ = _type_of(merged)
    if _has_variant(element):
        raise OperatorError(f"{json_column}: its records do not make a table: a field holds values of different types")
    rows = df.where(col(json_column).isNotNull()).select(
        *kept, F.explode(F.from_json(col(json_column), element, {"mode": "FAILFAST"})).alias("__r"))
    return rows.select(*kept, "__r.*")


_NAME = re.compile(r"`((?:[^`]|``)*)`|([^:`]+)")
_PLAIN = re.compile(r"[A-Z_ ]+(?:\((\d+), ?(\d+)\))?")


def _type_of(told: str, at: int = 0) -> tuple[T.DataType, int]:
    """The type that a variant's schema tells from a place on, and where it ends. Objects are structs, a field that is
    always null is text; whole numbers (told as decimals without places) are bigint, or decimal where they need more
    digits, and other decimals are double."""
    if told.startswith("ARRAY<", at):
        element, at = _type_of(told, at + 6)
        return T.ArrayType(element), at + 1
    if told.startswith("OBJECT<", at):
        fields, at = [], at + 7
        while told[at] != ">":
            name = _NAME.match(told, at)
            kind, at = _type_of(told, name.end() + 2)  # (a colon and a space stand between)
            fields.append(T.StructField(name[1].replace("``", "`") if name[1] is not None else name[2], kind))
            at += 2 * told.startswith(", ", at)
        return T.StructType(fields), at + 1
    plain = _PLAIN.match(told, at)
    if plain[1]:
        digits, places = int(plain[1]), int(plain[2])
        return (T.DoubleType() if places else T.LongType() if digits <= 18 else T.DecimalType(38, 0)), plain.end()
    word = plain[0].strip()
    return (T.StringType() if word == "VOID" else T.DataType.fromDDL(word)), plain.end()


def _has_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_variant(f.dataType) for f in dtype)
    return _has_variant(dtype.elementType) if isinstance(dtype, T.ArrayType) else isinstance(dtype, T.VariantType)


def records_of_text(spark: SparkSession, text: str) -> DataFrame:
    """One JSON text of records as a table."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise OperatorError(f"the text is not JSON: {e}") from None
    if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
        raise OperatorError("the text is not a list of records (an object per row)")
    if not found:
        return spark.createDataFrame([], T.StructType([]))
    return records_to_table(spark.createDataFrame([(text,)], "records string"), "records")
