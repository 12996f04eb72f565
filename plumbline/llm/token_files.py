"""Token ids as Parquet files: one row per document, in ascending order of its key.

`ids` is a list column in dictionary encoding (the dictionary of a row group is at most the vocabulary), the key and
`n_tokens` are delta encoded, row groups and pages have set sizes, and every file carries page indexes. So a reader of
some documents touches only their pages, and a reader of counts (`token_index`) never touches an id.

Ids are those that the library gives with add_special_tokens=False: the string of an added token in a text is that token.
Null and empty texts have the end id alone. Null keys come first. Rows that are equal stay equal rows. The files' order
is that of their part numbers, the rows' order that in their file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .frames import map_slices
from .library_ids import encoder, share, texts_of

ROW_GROUP, PAGE = 16 << 20, 128 << 10  # bytes
ROWS = 2048  # texts encoded together


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text of `docs` by a tokenizers file (its path on the driver; its content is broadcast, a file of
    fixed size), appends `end_id`, and writes the files to `path`. One shuffle, by ranges of the key; texts are encoded
    after it, where they are written. Other columns of `docs` play no part."""
    shared = share(docs, tokenizer)
    kind = docs.schema[key].dataType.simpleString()
    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    ordered = pairs.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))

    def run(batch: pa.RecordBatch) -> list:
        ids, counts = encoder(shared).encode(texts_of(batch.column(1)))
        flat = pa.array(np.insert(ids, np.cumsum(counts), end_id).astype("<i4"))
        sizes = counts + 1
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, flat, type=pa.list_(pa.field("element", pa.int32())))
        return [batch.column(0), pa.array(sizes), lists]

    (map_slices(ordered, f"key {kind}, n_tokens bigint, ids array<int>", run, ROWS)
     .withColumnRenamed("key", key).write.mode("errorifexists")
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.block.size", ROW_GROUP)
     .option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", 2000).parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with their place: `file` (its part number and name) and `row` in it."""
    rows = spark.read.parquet(path)
    name = F.col("_metadata.file_name")
    return rows.select(*rows.columns, F.struct(F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint").alias("part"), name.alias("name")).alias("file"),
                       F.col("_metadata.row_index").alias("row"))


def with_start(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """`start`: the ids of all documents before a row's (`counts`: the same files' rows, to be read for their counts
    alone). Ids before it in its file by a window over that file's rows (a
    file is one range of the key, of bounded size), and those of the files before by one row per file."""
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    files = (rows if counts is None else counts).groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = F.sum("in_file").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return (rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "file")
            .withColumn("start", F.col("before") + F.col("inside")).drop("file", "row", "before", "inside", "in_file"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Key, `n_tokens` and `start` of every document, read without its ids."""
    return with_start(read_token_files(spark, path).drop("ids"))


def token_checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, `start`, `n_tokens` and `ids_crc32` (of the ids as little-endian unsigned 32-bit integers), from the files."""
    import zlib

    rows = read_token_files(spark, path)
    kind = rows.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        lists = batch.column(2)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return [batch.column(0), batch.column(1), batch.column(3), batch.column(4), sums]

    made = map_slices(rows.select(key, "n_tokens", "ids", "file", "row"),
                      f"{key} {kind}, n_tokens bigint, file struct<part: bigint, name: string>, row bigint, ids_crc32 bigint", run)
    return with_start(made, rows.select("file", "n_tokens"))
