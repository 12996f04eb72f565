"""The records of CSV files whose quoted fields hold line ends, found by many tasks.

Where a line of such a file stands in its record depends on all quotes before it, but only by one bit: whether a quote is
open. So each stretch of a file that Spark reads as one split is gone over once for both answers, which gives its effect on
that bit; the effects of the splits before are put together, which says how each split begins; and then every split is cut
into records on its own. What a split has of a record that began before it goes, with the part that began it, to whoever
puts the two together: two pieces a split at most."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.lineage import cut

HEAD, TAIL = 0, 1  # pieces of records: up to their end, or all of a split; from their start on


def line_scanner(separator: str) -> Callable[[str, bool], bool]:
    """scan(line, open): whether a quote is open after a line, if one was before it. A quote opens a field only as its
    first character; one inside a quoted field is written twice; what follows a closing quote up to the separator, and
    quotes inside other fields, mean nothing."""
    part = re.escape(separator)
    rest_of_quoted = re.compile(f'(?:[^"]|"")*+"[^{part}]*+(?:{part}|$)' if separator != '"' else "$^", re.S)
    field = re.compile(f'[^"{part}][^{part}]*+(?:{part}|$)|{part}', re.S)

    def scan(line: str, open_: bool) -> bool:
        at = 0
        while True:
            if open_:
                found = rest_of_quoted.match(line, at)
                if found is None:
                    return True
                at, open_ = found.end(), False
            if at >= len(line):
                return False
            if line[at] == '"':
                at, open_ = at + 1, True
                continue
            at = field.match(line, at).end()

    return scan


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): a file's lines, each split's in its order and in one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list, bool, list[str]]]:
    """(file, split, the other columns, whether it goes on from the batch before, lines)"""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, splits, lines = (batch.column(i).to_pylist() for i in (0, 1, batch.num_columns - 1))
        at = 0
        while at < len(files):
            end = at + 1
            while end < len(files) and (files[end], splits[end]) == (files[at], splits[at]):
                end += 1
            yield files[at], splits[at], [batch.column(i)[at].as_py() for i in range(2, batch.num_columns - 1)], last == (files[at], splits[at]), lines[at:end]
            last = files[at], splits[at]
            at = end


def split_states(lines: DataFrame, separator: str) -> DataFrame:
    """(file, split, open): whether a quote is open where each split begins."""
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, key, ends = line_scanner(separator), None, [False, True]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "split": pa.array([key[1]], pa.int64()), "closed": [ends[0]], "opened": [ends[1]]})

        for file, split, _, goes_on, part in _in_splits(batches):
            if not goes_on:
                if key is not None:
                    yield told()
                key, ends = (file, split), [False, True]
            for line in part:
                if '"' in line:
                    ends = [scan(line, e) for e in ends] if ends[0] != ends[1] else [scan(line, ends[0])] * 2
        if key is not None:
            yield told()

    found = lines.mapInArrow(effects, "file string, split bigint, closed boolean, opened boolean")
    # A split leaves the bit as it is, turns it, or sets it: what holds is the last set, turned by what came after.
    order = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # (a row per split)
    sets = F.when(F.col("closed") == F.col("opened"), F.col("closed"))
    turned = found.withColumns({"turns": (F.col("closed") & ~F.col("opened")).cast("int"), "sets": sets})
    upto = turned.withColumn("before", F.coalesce(F.sum("turns").over(order), F.lit(0)))
    base = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", F.col("before").alias("turns"))), ignorenulls=True).over(order)
    based = upto.withColumn("base", base)
    start = F.coalesce(F.col("base.sets"), F.lit(False))
    flips = (F.col("before") - F.coalesce(F.col("base.turns"), F.lit(0))) % 2 == 1
    return based.select("file", "split", (start != flips).alias("open"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "\r$", "")


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, first, record): every record of the CSV files at `path` as text, line ends in quoted fields and all; `first`
    for the record that starts a file. A quote left open at a file's end ends there. Blank lines are no records. Stored, as
    records in one split and the pieces of others both come from it."""
    lines = _lines(spark, path)
    states = split_states(lines, separator)
    given = lines.join(F.broadcast(states), ["file", "split"]).select("file", "split", "open", "value")  # (a row per split)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, key, state, begun, piece = line_scanner(separator), [], None, False, False, HEAD

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "split", "piece", "first", "record"])

        for file, split, (open_,), goes_on, part in _in_splits(batches):
            out = []
            if not goes_on:
                if held:
                    out.append((*key, piece, key[1] == 0 and not begun, "\n".join(held)))
                held, key, state, begun, piece = [], (file, split), open_, False, HEAD if open_ else TAIL
            for line in part:
                held.append(line)
                state = scan(line, state) if '"' in line else state
                if not state:
                    text = "\n".join(held)
                    whole = piece == TAIL
                    if not whole or text.strip("﻿ \t\r"):
                        out.append((*key, None if whole else HEAD, key[1] == 0 and not begun and whole, text))
                        begun = begun or whole
                    held, piece = [], TAIL
            yield table(out)
        if held:
            yield table([(*key, piece, key[1] == 0 and not begun, "\n".join(held))])

    return _joined(cut(given.mapInArrow(cut_up, "file string, split bigint, piece int, first boolean, record string")))


def _joined(found: DataFrame) -> DataFrame:
    """Records in one split as they are, the pieces of others joined."""
    whole = found.where("piece IS NULL").select("file", "first", _plain(F.col("record")).alias("record"))
    pieces = found.where("piece IS NOT NULL")
    order = W.partitionBy("file").orderBy("split", "piece").rowsBetween(W.unboundedPreceding, 0)  # (two rows per split at most)
    starts = F.last(F.when(F.col("piece") == TAIL, F.col("split")), ignorenulls=True).over(order)
    joined = pieces.withColumn("starts", starts).groupBy("file", "starts").agg(
        F.max("first").alias("first"), F.array_join(F.sort_array(F.collect_list(F.struct("split", "piece", "record")))["record"], "\n").alias("record"))
    return whole.unionByName(joined.select("file", "first", _plain(F.col("record")).alias("record")))
