"""Reading and writing tables as files, file listings, row numbers."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col
from ..plans.lineage import cut
from .commits import commit_table, hadoop, read_committed, versions
from .csv_records import csv_records

# The format a file's extension says.
EXTENSIONS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet"}
EMPTY_TEXT = "\u0001empty\u0001"  # stands for a quoted "" while a CSV is read: Spark alone would make it null


def format_of(path: str, fmt: str = "auto") -> str:
    """The format given, or the one the extension says."""
    if fmt in ("csv", "parquet"):
        return fmt
    if fmt != "auto":
        raise OperatorError(f"format {fmt!r} is none of auto, csv, parquet")
    found = EXTENSIONS.get(posixpath.splitext(path.rstrip("/"))[1].lower())
    if not found:
        raise OperatorError(f"cannot tell the file format of {path!r}; set format to csv or parquet")
    return found


def escape_glob(path: str) -> str:
    """A path Spark takes as it is: `sales [EU].csv` is that file, not a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, found = hadoop(spark, path)
    return fs.exists(found)


def read_table(spark: SparkSession, path: str, format: str = "auto", separator: str = ",",
               parse_dates: bool = False) -> DataFrame:
    """A CSV or Parquet file (or folder of them) as a table. CSV: a header row, types from all its values, dates as text
    unless parse_dates; an empty field is null, a quoted empty one is empty text."""
    fmt = format_of(path, format)
    if not path_exists(spark, path):
        raise OperatorError(f"file not found: {path}")
    if fmt == "parquet":
        return read_committed(spark, path) if versions(spark, path) else spark.read.parquet(escape_glob(path))
    if len(separator) != 1:
        raise OperatorError(f"separator is one character, got {separator!r}")
    return _read_csv(spark, path, separator, parse_dates)


def _read_csv(spark: SparkSession, path: str, separator: str, parse_dates: bool) -> DataFrame:
    readable = escape_glob(path)
    lines = spark.read.text(readable)
    head = lines.first()
    if head is None or not head[0].strip("\ufeff \t\r"):
        raise OperatorError(f"{path} is empty: a CSV file starts with a row of column names")
    # Quoted fields may hold line ends. Where no line has an odd number of quotes, lines are rows; else records are found first.
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    facts = lines.agg(F.max(quotes % 2 == 1).alias("multiline"), F.min(F.is_valid_utf8("value")).alias("utf8")).first()
    multiline = facts["multiline"]
    if not facts["utf8"]:
        raise OperatorError(f"{path} is not UTF-8 text")
    def reader(infer: bool):
        return (spark.read.option("header", not multiline).option("sep", separator)
                .option("inferSchema", infer).option("escape", '"').option("emptyValue", EMPTY_TEXT)
                .option("mode", "FAILFAST").option("enforceSchema", True).option("encoding", "UTF-8"))

    if multiline:
        records = csv_records(spark, readable, separator)
        names = _names_in(records.where("first").orderBy("file").first()["record"], separator)
        texts = getattr(records.where("NOT first").select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return _typed(lambda infer, schema: DataFrame((reader(infer).schema(schema) if schema else reader(infer))._jreader.csv(texts), spark),
                      names, parse_dates)
    return _typed(lambda infer, schema: (reader(infer).schema(schema) if schema else reader(infer)).csv(readable), None, parse_dates)


def _names_in(header: str, separator: str) -> list[str]:
    """The column names that a CSV record of them gives; a nameless one is named by its place, as Spark does."""
    found = next(csv.reader(io.StringIO(header.removeprefix("\ufeff"), newline=""), delimiter=separator, strict=False))
    return [name if name else f"_c{i}" for i, name in enumerate(found)]


def _typed(read, names: list[str] | None, parse_dates: bool) -> DataFrame:
    """A CSV table by `read(infer, schema)` with the types that its values allow, dates as text unless asked for."""
    guessed = read(True, None).schema
    if names is not None:
        known = {f.name: f.dataType for f in guessed}
        guessed = T.StructType([T.StructField(n, known.get(f"_c{i}", T.StringType())) for i, n in enumerate(names)])
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    fields = []
    for f in guessed:
        kept = f.dataType
        if isinstance(kept, dated) and not parse_dates:
            kept = T.StringType()
        if isinstance(kept, T.IntegerType):
            kept = T.LongType()
        fields.append(T.StructField(f.name.removeprefix("\ufeff"), kept, True))
    df = read(False, T.StructType(fields))
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(col(n) == EMPTY_TEXT, "").otherwise(col(n)) for n in texts}) if texts else df


def write_table(df: DataFrame, path: str, format: str = "auto", max_records_per_file: int | None = None,
                partition_by=(), commits: bool = False) -> str:
    """Write a table, replacing what is at `path`. It is written beside it first and then takes its place, so a table
    read from that very path can be written back over it. Between the two moves that this takes there is no table at
    `path` for others; with `commits` (Parquet), and over a table once written so, there always is: see commit_table."""
    fmt = format_of(path, format)
    spark = df.sparkSession
    if fmt == "parquet" and (commits or versions(spark, path)):
        if commits and path_exists(spark, path) and not versions(spark, path):
            raise OperatorError(f"{path} is there and no committed table: write it to another place")
        commit_table(df, path, partition_by, max_records_per_file)
        return path
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        if nested:
            raise OperatorError(f"{', '.join(nested)}: a CSV file holds no lists or nested values; write Parquet, or make "
                                "them text first")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    writer = df.write.mode("errorifexists")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", '""').option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(beside)
    else:
        writer.parquet(beside)
    fs, made = hadoop(spark, beside)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OperatorError(f"cannot move {path} aside")
    if not fs.rename(made, target):
        if there:
            fs.rename(aside, target)  # (the old table is back where it was)
        raise OperatorError(f"cannot put {beside} in the place of {path}")
    if there:
        fs.delete(aside, True)
    spark.catalog.refreshByPath(path)
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table as stored: in `path` as Parquet, or in the checkpoint folder; later steps start from there."""
    if path is None:
        return cut(df)
    write_table(df, path, "parquet", commits=not path_exists(df.sparkSession, path))
    return read_table(df.sparkSession, path, "parquet")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """The files at a path, or whose name matches a pattern in its last part: path, size, modified. Folders do not
    count. A file whose name is the pattern itself is that file."""
    folder, name = posixpath.split(pattern)
    as_named = path_exists(spark, pattern)
    fs, at = hadoop(spark, escape_glob(pattern) if as_named else posixpath.join(escape_glob(folder), name))
    # (asked of the file system: Spark's own file sources pass over empty files, which a check wants to see)
    found = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.globStatus(at) or [] if s.isFile()]
    listed = spark.createDataFrame(found, "path string, size bigint, at bigint")
    return listed.select("path", "size", F.timestamp_millis("at").alias("modified"))


# Steps of a plan that give each row of the files at most once; any other may give one twice, or one of its own.
_ONCE = {"Project", "Filter", "SubqueryAlias", "View", "Relation", "LogicalRelation"}


def _has_places(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def _steps(df: DataFrame) -> set[str]:
    """The names of the steps of a table's plan."""
    found, left = set(), [df._jdf.queryExecution().analyzed()]
    while left:
        step = left.pop()
        found.add(step.nodeName().split(" ")[0])
        children = step.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


def _is_whole(df: DataFrame) -> bool:
    """True for a table of files with all their rows: nothing stands between it and the files but picked columns."""
    return _steps(df) <= _ONCE - {"Filter"}


def in_places(df: DataFrame) -> DataFrame:
    """The table with a place of its own for each row: itself where it is read from Parquet files and each of its rows is
    one of theirs, else stored once (rows that a step made of one row, as explode does, come in the order it made them)."""
    return df if _has_places(df) and _steps(df) <= _ONCE else cut(df)


def place() -> Column:
    """A row's place in a table as in_places gives it: its file and its place in the file. The order of the places is
    that of the file names, whatever the files' sizes and however Spark packs them."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def row_numbers(df: DataFrame, places: list) -> dict:
    """The numbers from 1 of a few rows, by their places in a table as in_places gives it: how many rows come before each,
    in one pass that shuffles nothing."""
    if not places:
        return {}
    at = [F.struct(F.lit(p["file"]).alias("file"), F.lit(p["row"]).cast("bigint").alias("row")) for p in places]
    before = df.select(place().alias("p")).agg(*[F.count_if(F.col("p") < x).alias(f"n{i}") for i, x in enumerate(at)]).first()
    return {p: before[i] + 1 for i, p in enumerate(places)}


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table with each row's true number from 1, on one file or many; tables that are not read from Parquet files are
    stored first, and their rows counted there."""
    return with_row_number(in_places(df), name)


def with_row_number(df: DataFrame, name: str = "row_number", order_by=()) -> DataFrame:
    """The table with each row's number from 1, without jumps: its files in the order of their names and its rows in
    their order in the file, or the order of `order_by` columns.

    Files are counted first; a row's number is its place in its file and the rows of the files before. In the order of
    columns, rows are range partitioned and stored, and each stored partition counted the same way."""
    if order_by:
        # (many rows equal in order are still split: by their place in their file, or else by their other columns)
        tie = F.xxhash64(*[col(c) for c in df.columns])
        try:
            tied = df.withColumns({"__tie": tie, "__in_file": F.col("_metadata.row_index")})
        except AnalysisException:
            tied = df.withColumns({"__tie": tie, "__in_file": F.lit(0)})
        order = [*[col(c) for c in order_by], F.col("__tie"), F.col("__in_file")]
        ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie", "__in_file")
        part = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
        nth = F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    else:
        if not _has_places(df) or not _steps(df) <= _ONCE:
            raise OperatorError("the table's rows are not those of Parquet files: give order_by columns")
        if not _is_whole(df):  # (some rows of the files: numbered among themselves, in the order of their places)
            return with_row_number(df.withColumn("__place", place()), name, ["__place"]).drop("__place")
        part = df.withColumns({"__part": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
        nth = F.col("__at") + 1
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))  # (a row per file or partition)
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return part.join(offsets, "__part").withColumn(name, nth + F.col("__before")).drop("__part", "__at", "__before")


def as_table(spark: SparkSession, value) -> DataFrame:
    """A DataFrame as it is; a pandas, Arrow or other frame (with to_arrow) as a DataFrame."""
    if isinstance(value, DataFrame):
        return value
    if type(value).__module__.split(".")[0] in ("pandas", "pyarrow"):
        return spark.createDataFrame(value)
    if hasattr(value, "collect") and not hasattr(value, "to_arrow"):
        value = value.collect()
    if hasattr(value, "to_arrow"):
        return spark.createDataFrame(value.to_arrow())
    raise OperatorError(f"a table is needed, got {type(value).__name__}")
