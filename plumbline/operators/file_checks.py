"""Checks of files that should have arrived, over a listing of them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import OperatorError
from ..functions.scalars import SIZE_UNITS
from ..plans.ordered import any_of

RESULTS = T.StructType([T.StructField(n, T.StringType()) for n in ("check", "outcome", "details")])
NAMED = 100  # broken files that a message names; `broken` has them all


def to_bytes(text: str) -> float:
    """200 MB as bytes (1 KB = 1024)."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMG]?B)", text.strip(), re.I)
    if not found:
        raise OperatorError(f"{text!r} is not a size: write a number and a unit, B, KB, MB or GB, e.g. 200 MB")
    return float(found[1]) * SIZE_UNITS[found[2].upper()]


@dataclass
class FileCheckResult:
    passed: bool
    results: DataFrame
    files: DataFrame
    failures: list[str]
    broken: DataFrame  # every broken file, once per check: check, path, size, modified, details

    def require(self) -> DataFrame:
        if not self.passed:
            raise OperatorError("; ".join(self.failures), results=self.results)
        return self.files


@dataclass(frozen=True)
class _FileRule:
    """What a file must not be: where `broken` is true, `told` says of it what it is; `good` says what all others are."""

    key: str
    title: str
    broken: Column
    told: Column
    good: str


def _rules(not_empty: bool, modified_since, minimum: str | None, maximum: str | None) -> Iterator[_FileRule]:
    size, path = F.col("size"), F.col("path")
    if not_empty:
        yield _FileRule("not_empty", "Not empty", size == 0, F.concat(path, F.lit(" holds nothing")), "holds something")
    if modified_since is not None:
        since = modified_since if isinstance(modified_since, dt.datetime) else dt.datetime.combine(modified_since, dt.time())
        limit = F.lit(since) if since.tzinfo else F.to_timestamp(F.lit(since.isoformat(" ")))  # (a clock time: the session's)
        told = F.format_string(f"%s is from %s, older than {since}", path, F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))
        yield _FileRule("modified", "Modified since", F.col("modified") < limit, told, f"is from {since} or later")
    bounds = [(word, short, text, to_bytes(text)) for word, short, text in (("at least", "under", minimum), ("at most", "over", maximum)) if text is not None]
    if bounds:
        outside = [size < n if word == "at least" else size > n for word, _, _, n in bounds]
        which = F.coalesce(*[F.when(out, F.lit(f"{short} {text}")) for out, (_, short, text, _) in zip(outside, bounds)], F.lit(""))
        yield _FileRule("size", "Size", any_of(outside), F.concat(path, F.lit(" is "), F.format_number("size", 0), F.lit(" bytes, "), which),
                        f"is {' and '.join(f'{word} {text}' for word, _, text, _ in bounds)}")


def check_files(files: DataFrame, not_empty: bool = False, modified_since: dt.date | None = None,
                minimum: str | None = None, maximum: str | None = None, warn=()) -> FileCheckResult:
    """Check a listing (path, size, modified): that there is a file, and as asked that none is empty, none was last
    changed before a date or time, and each has a size within limits. `warn`: the checks whose failure only warns
    ("there", "not_empty", "modified", "size"). One pass counts what is broken; only broken files are named."""
    rules = list(_rules(not_empty, modified_since, minimum, maximum))
    counts = files.agg(F.count("*").alias("files"), *[F.count_if(rule.broken).alias(rule.key) for rule in rules]).first()

    def details(rule: _FileRule) -> str:
        if not counts["files"]:
            return "there was nothing to look at"
        if not counts[rule.key]:
            return f"each file {rule.good}"
        first = [r[0] for r in files.where(rule.broken).orderBy("path").limit(NAMED).select(rule.told).collect()]
        rest = counts[rule.key] - len(first)
        return ", ".join(first) + (f" and {rest:,} more" if rest else "")

    there = f"{counts['files']:,} here" if counts["files"] else "nothing here"
    found = [("there", "It is there", not counts["files"], there), *[(r.key, r.title, bool(counts[r.key]), details(r)) for r in rules]]
    outcomes = [(title, ("warned" if key in warn else "failed") if broken else "passed", said) for key, title, broken, said in found]
    failures = [f"{title}: {said}" for title, outcome, said in outcomes if outcome == "failed"]
    marks = [F.when(r.broken, F.struct(F.lit(r.title).alias("check"), r.told.alias("details"))) for r in rules]
    listed = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<struct<check: string, details: string>>")
    broken = files.select("*", F.explode(listed).alias("__b")).select("__b.check", "path", "size", "modified", "__b.details")
    return FileCheckResult(not failures, files.sparkSession.createDataFrame(outcomes, RESULTS), files, failures, broken)
