"""Tables replaced by a commit: a reader finds the old table or the new one, whole, at any moment.

A committed table is a folder with manifests, `_commits/1`, `_commits/2` and so on, and data folders, `_data/<name>`. A write
puts its files into a data folder of its own, which nobody reads yet, and then makes the next manifest, which names it. Only
one writer can make a manifest of a number: the file is written beside and gets its name in one step that fails where the
name is taken. The latest manifest tells which folder is the table. A write that dies leaves a folder that no manifest
names; the table stays as it was.

That one step is a hard link on a machine's own files and a rename elsewhere, as HDFS has it; stores whose rename is a copy
need a writer of their own."""

from __future__ import annotations

import datetime as dt
import json
import os
import posixpath
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from ..errors import OperatorError

COMMITS, DATA = "_commits", "_data"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def _join(path: str, *parts: str) -> str:
    return posixpath.join(path.rstrip("/"), *parts)


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content; False if there is one of that name. Of any number of writers one succeeds, and who
    finds the file finds all of it."""
    fs, target = hadoop(spark, path)
    folder = target.getParent()
    fs.mkdirs(folder)
    beside = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            here = lambda p: unquote(urlparse(fs.makeQualified(p).toUri().toString()).path)
            try:
                os.link(here(beside), here(target))
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(beside, target)
    finally:
        fs.delete(beside, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's content; None where there is no such file."""
    fs, found = hadoop(spark, path)
    if not fs.exists(found):
        return None
    opened = fs.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a committed table's manifests, in order; none where the folder is no committed table."""
    fs, folder = hadoop(spark, _join(path, COMMITS))
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    text = read_text(spark, _join(path, COMMITS, str(version)))
    if text is None:
        raise OperatorError(f"{path} has no version {version}")
    return json.loads(text)


def commit_table(df: DataFrame, path: str, partition_by=(), max_records_per_file: int | None = None, expected: int | None = None) -> int:
    """Write `df` as the table's next version, as Parquet; its number. `df` may read the table itself. Of writers at the
    same time each makes a version, and the last one holds; with `expected`, the version that `df` was made from (0: none),
    the write fails where another came first."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    if expected is not None and (versions(spark, path) or [0])[-1] != expected:
        raise OperatorError(f"{path}: version {expected} is no longer the latest; read the table again")
    writer = df.write.mode("errorifexists")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(_join(path, DATA, name))
    manifest = json.dumps({"data": name, "at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")})
    number = 1 + (expected if expected is not None else (versions(spark, path) or [0])[-1])
    while not claim(spark, _join(path, COMMITS, str(number)), manifest):
        if expected is not None:
            _delete(spark, _join(path, DATA, name))
            raise OperatorError(f"{path}: version {expected} is no longer the latest; read the table again")
        number += 1
    return number


def read_committed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its latest manifest has it, or as an earlier one that is still kept."""
    there = versions(spark, path)
    if not there:
        raise OperatorError(f"{path} is no committed table")
    data = _manifest(spark, path, there[-1] if version is None else version)["data"]
    return spark.read.parquet(_join(path, DATA, data))


def drop_versions(spark: SparkSession, path: str, keep: int = 2, left_before: dt.datetime | None = None) -> int:
    """Delete all but the latest `keep` versions; how many went. `left_before`: also data folders older than that which no
    manifest names: what dead writes left (a moment before any write now going on began)."""
    if keep < 1:
        raise OperatorError(f"keep is 1 or more, got {keep}")
    there = versions(spark, path)
    gone = there[:-keep]
    for version in gone:
        data = _manifest(spark, path, version)["data"]
        _delete(spark, _join(path, COMMITS, str(version)))
        _delete(spark, _join(path, DATA, data))
    if left_before is not None:
        named = {_manifest(spark, path, v)["data"] for v in versions(spark, path)}
        fs, folder = hadoop(spark, _join(path, DATA))
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in named and status.getModificationTime() / 1000 < left_before.timestamp():
                fs.delete(status.getPath(), True)
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    fs, found = hadoop(spark, path)
    fs.delete(found, True)
