"""Cutting a plan's lineage in storage that outlives an executor."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import OperatorError

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED: list[str] = []  # the folders that this process has cut tables into


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints. Where it names none, a local session gets a folder of its
    machine; a cluster, whose machines do not share one, gets an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise OperatorError("set spark.checkpoint.dir to a folder that the driver and all executors share: steps "
                                    "that are used more than once are stored there")
            folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def forget_stored(spark: SparkSession) -> int:
    """Delete the steps that this process has stored, once no table that reads them is needed any more; how many."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    gone = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` returned and nothing reads any more, neither themselves nor tables made of them."""
    for table in tables:
        name = vars(table).get("stored_at")
        if name in _STORED:
            _STORED.remove(name)
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes a job's shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def cut(df: DataFrame, *more: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read back from there by every later use: as Parquet, so that later uses
    read only their columns and know its size; as a checkpoint where a column has a type Parquet does not. With `more`,
    tables of the same columns, the rows of all: they are made one after another, and no shuffle outlives the table it is for."""
    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    try:
        with _shuffles_dropped(spark):
            for part in (df, *more):
                part.write.mode("append").parquet(path)
    except AnalysisException:
        return reduce(DataFrame.unionByName, more, df).checkpoint(eager=True)
    _STORED.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made
