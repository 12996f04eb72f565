"""Helpers of the operators here: rows to Python in small slices, stored steps, words of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import cut, forget

__all__ = ["WORD_SPLIT", "cut", "forget", "let", "map_slices", "parts_of", "word_array", "words_of"]

#: What stands between words: the space and U+0009 to U+000D.
WORD_SPLIT = "[ \\t-\\r]+"
SLICE = 256  # rows that one step of a Python operator holds besides its Arrow batch


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 (bytes.split parts at just those characters); null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_array(text: Column) -> Column:
    """The same words as an array of strings, by Spark's own functions; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with `value` worked out once however often `then` uses it, within lambdas too."""
    return F.transform(F.array(value), then)[0]


def parts_of(table: DataFrame, by: str, parts: int) -> list[DataFrame]:
    """`table` in so many parts by the hash of a column: steps that go by it can be done one part after another."""
    return [table if parts == 1 else table.where(F.pmod(F.xxhash64(by, F.lit("part")), F.lit(parts)) == i) for i in range(parts)]


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], list], rows: int = SLICE,
               done: Callable[[], None] | None = None) -> DataFrame:
    """`fn` over slices of at most `rows` rows: it gets a record batch and returns a list of columns for `schema` (of any
    common length). Memory beyond the Arrow batch is that of one slice, whatever the partition holds. `done` is called at a
    task's end: Spark keeps Python workers for later tasks, of other operators too, and what they hold with them."""
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(kinds)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    columns = fn(batch.slice(at, rows))
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)
        finally:
            if done is not None:
                done()

    return df.mapInArrow(run, kinds)
