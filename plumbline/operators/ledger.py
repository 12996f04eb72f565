"""The run ledger as tables, and what is asked of it.

Four append-only Parquet tables: runs and steps (a row per event; the latest event is the state), logs, and lineage
(which run a re-run carried on from). The questions are functions of DataFrames, for one flow or for all at once."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col, need_columns
from ..functions.readers import micros
from ..plans.lineage import cut
from ..plans.ordered import KEY, key_of, running
from ..sources.commits import claim, hadoop, read_text
from ..sources.files import escape_glob, path_exists
from .checks import EarlierRun

# The ledger's tables and their columns.
TABLES = {
    "runs": "run_id bigint, flow string, flow_path string, params string, status string, started timestamp_ntz, "
            "finished timestamp_ntz, started_by string, counts_for string, version string, seq bigint",
    "steps": "run_id bigint, step string, status string, started timestamp_ntz, finished timestamp_ntz, attempts int, "
             "error string, rows bigint, query string, seq bigint",
    "logs": "run_id bigint, step string, ts timestamp_ntz, level string, message string, seq bigint",
    "lineage": "run_id bigint, carried_on_from bigint",
}
KEYS = {"runs": ["run_id"], "steps": ["run_id", "step"]}
GOING = "running"
NAMED = 5  # runs that a message names
DEFAULT_KEEP = "5 years"


class Ledger:
    """A ledger in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, table: str, rows) -> None:
        """Add rows: a DataFrame, or dicts with any of the table's columns."""
        schema = self._schema(table)
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        missing = [f for f in schema if f.name not in rows.columns]
        whole = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else rows
        # Written in a folder of its own, which then takes its place among the others: appends at one time don't meet.
        name = uuid.uuid4().hex
        beside, into = f"{self.folder}/_new/{name}", f"{self.folder}/{table}"
        whole.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(beside)
        fs, made = hadoop(self.spark, beside)
        fs.mkdirs(hadoop(self.spark, into)[1])
        if not fs.rename(made, hadoop(self.spark, f"{into}/{name}")[1]):
            raise OperatorError(f"cannot put {beside} into {into}")

    def events(self, table: str) -> DataFrame:
        schema, path = self._schema(table), f"{self.folder}/{table}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(escape_glob(path))

    def state(self, table: str) -> DataFrame:
        """Each run's or step's latest event."""
        return latest_state(self.events(table), KEYS[table], "seq") if table in KEYS else self.events(table)

    def run_number(self, flow: str, part: str) -> int:
        """The number of a flow's run known by its params (a batch): the one it has, or a new one that no run has, also of
        those that other writers begin at this moment. A number is taken by making a file of its name, which only one writer
        can; one whose writer then dies stays unused."""
        runs = self.events("runs")
        mine = F.max(F.when((col("flow_path") == flow) & (col("params") == part), F.col("run_id")))
        found = runs.agg(mine.alias("mine"), F.max("run_id").alias("last")).first()
        if found["mine"] is not None:
            return found["mine"]
        of_part = f"{self.folder}/_parts/{hashlib.sha256(json.dumps([flow, part]).encode()).hexdigest()}"
        taken = read_text(self.spark, of_part)
        if taken is None:
            number = (-1 if found["last"] is None else found["last"]) + 1
            while not claim(self.spark, f"{self.folder}/_numbers/{number}", json.dumps([flow, part])):
                number += 1
            # (the same batch, begun twice, has the number of whoever tells it first)
            taken = str(number) if claim(self.spark, of_part, str(number)) else read_text(self.spark, of_part)
        return int(taken)

    def _schema(self, table: str):
        if table not in TABLES:
            raise OperatorError(f"the ledger has no table {table!r} (its tables: {', '.join(TABLES)})")
        return T.StructType.fromDDL(TABLES[table])


def latest_state(events: DataFrame, keys, order: str) -> DataFrame:
    """The latest row of each key: a maximum, so it is half worked out before the shuffle, however long a key's past."""
    rest = [c for c in events.columns if c not in keys]
    # (events of one number, written twice, are told apart by what else they say)
    whole = F.struct(*[col(c) for c in rest])
    newest = F.max_by(whole, F.struct(col(order).alias("o"), F.xxhash64(*[col(c) for c in rest]).alias("t"))).alias("__n")
    return events.groupBy(*[col(k) for k in keys]).agg(newest).select(*keys, "__n.*").select(*events.columns)


def latest_runs(runs: DataFrame, flow_path: str | None = None, limit: int = 200) -> DataFrame:
    found = runs if flow_path is None else runs.where(col("flow_path") == flow_path)
    return found.orderBy(F.desc("run_id")).limit(limit)


def _started_by(names) -> Column:
    return F.arrays_overlap(F.split("started_by", ", "), F.array(*[F.lit(n) for n in names]))


def last_run(runs: DataFrame, flow_path: str, started_by) -> DataFrame:
    """The newest finished run of a flow that one of some starts started."""
    finished = runs.where((col("flow_path") == flow_path) & (col("status") != GOING) & _started_by(started_by))
    return finished.orderBy(F.desc("run_id")).limit(1)


def _results(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Each finished step's result with its run's flow, start and starter."""
    of_run = runs.select("run_id", "flow_path", F.col("started").alias("run_started"), "started_by")
    return steps.where("status != 'running'").join(of_run, "run_id")


def last_success(runs: DataFrame, steps: DataFrame, flow_path: str, step: str, before: int) -> DataFrame:
    """A step's result in the latest earlier run in which it succeeded, whatever became of the run."""
    found = _results(runs, steps.where(col("step") == step)).where(
        (col("flow_path") == flow_path) & (col("status") == "success") & (col("run_id") < before))
    return found.orderBy(F.desc("run_id")).limit(1)


def earlier_run(runs: DataFrame, steps: DataFrame, flow_path: str, step: str, before: int) -> EarlierRun | None:
    """What RowCountCompared compares with: the rows of a step's latest earlier success."""
    found = last_success(runs, steps, flow_path, step, before).select("run_id", "rows").first()
    return found and EarlierRun(found["run_id"], found["rows"])


def previous_success(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every step result with the run and rows of its step's latest earlier success (previous_run, previous_rows)."""
    found = _results(runs, steps)
    good = F.when(F.col("status") == "success", F.struct("run_id", "rows"))
    keyed = found.withColumns({KEY: key_of(["flow_path", "step"]), "__good": good})
    seen = running(keyed, KEY, ["run_id"], {"__last": ("last", "__good")}, before=True)
    return seen.withColumns({"previous_run": F.col("__last.run_id"), "previous_rows": F.col("__last.rows")}).drop(
        KEY, "__good", "__last")


def latest_per_step(runs: DataFrame, steps: DataFrame, flow_path: str | None = None, after: int = 0) -> DataFrame:
    """Each step's result in the latest run (after a run) that it took part in, for one flow or all."""
    found = _results(runs, steps).where(col("run_id") > after)
    if flow_path is not None:
        found = found.where(col("flow_path") == flow_path)
    return latest_state(found, ["flow_path", "step"], "run_id")


def step_results(runs: DataFrame, steps: DataFrame, flow_path: str, step: str, limit: int = 200) -> DataFrame:
    found = _results(runs, steps.where(col("step") == step)).where(col("flow_path") == flow_path)
    return found.orderBy(F.desc("run_id")).limit(limit)


def latest_per_version(runs: DataFrame, flow_path: str | None = None) -> DataFrame:
    """The latest finished run of each version a flow ran as."""
    found = runs.where("version IS NOT NULL AND status != 'running'")
    if flow_path is not None:
        found = found.where(col("flow_path") == flow_path)
    return latest_state(found.select("flow_path", "version", "run_id", "started", "finished"), ["flow_path", "version"], "run_id")


def steps_in_order(steps: DataFrame, run_id: int) -> DataFrame:
    """A run's finished steps in the order they finished."""
    return steps.where((col("run_id") == run_id) & (col("status") != GOING)).orderBy("finished", "seq")


def queries_sent(steps: DataFrame, run_id: int) -> DataFrame:
    found = steps.where((col("run_id") == run_id) & col("query").isNotNull())
    return found.orderBy("started", "seq").select("step", "query", "started")


def logs_in_order(logs: DataFrame, run_id: int) -> DataFrame:
    return logs.where(col("run_id") == run_id).orderBy("seq")


def carried_on(lineage: DataFrame, run_id: int, runs: DataFrame | None = None) -> DataFrame:
    """The runs that carried on from a run, directly or through others: run_id, newest first (with `runs`: those there
    and finished). They are the runs whose chain begins with it once what it carried on from itself is left out; circles
    elsewhere in the table do not matter."""
    found = _chains(lineage.where(col("run_id") != run_id))[0].where(col("root") == run_id).select("run_id")
    if runs is not None:
        found = runs.where(col("status") != GOING).select("run_id").join(found, "run_id", "left_semi")
    return found.orderBy(F.desc("run_id"))


def lineage_roots(lineage: DataFrame) -> DataFrame:
    """Every re-run with the run its chain began with and how many re-runs lie between: run_id, root, depth. Runs that
    carry on from each other in a circle, or from such runs, have no root and are an error that names some."""
    settled, circling = _chains(lineage)
    named = [r.run_id for r in circling.select("run_id").orderBy("run_id").limit(NAMED).collect()]
    if named:
        raise OperatorError(f"lineage: runs carry on from each other in a circle, or from such runs: {', '.join(map(str, named))}"
                            + (", ..." if len(named) == NAMED else ""))
    return settled


def _chains(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs whose chain has a beginning (run_id, root, depth), and those whose chain has none.

    Each round doubles how far a run looks back, so a chain of a million re-runs takes twenty rounds, and only runs that
    have not come to a beginning are joined again. A chain is no longer than the table, which bounds the rounds."""
    steps = cut(lineage.select("run_id", F.col("carried_on_from").alias("root"), F.lit(1).cast("bigint").alias("depth")))  # (read twice)
    known = steps.select(F.col("run_id").alias("root"))
    moving = cut(steps.withColumn("more", F.lit(True)).join(known.withColumn("there", F.lit(True)).distinct(), "root", "left")
                 .select("run_id", "root", "depth", F.coalesce("there", F.lit(False)).alias("more")))
    settled, total = moving.where("NOT more").drop("more"), moving.count()
    going = moving.where("more").drop("more")
    for _ in range(total.bit_length() + 1):
        if going.isEmpty():
            break
        # where a run's look back ends, another's begins: a settled one brings it to the beginning
        ahead = settled.withColumn("done", F.lit(True)).unionByName(going.withColumn("done", F.lit(False)))
        ahead = ahead.select(F.col("run_id").alias("root"), F.col("root").alias("further"), F.col("depth").alias("longer"), "done")
        step = cut(going.join(ahead, "root").select("run_id", F.col("further").alias("root"), (F.col("depth") + F.col("longer")).alias("depth"), "done"))
        settled = settled.unionByName(step.where("done").drop("done"))
        going = step.where("NOT done").drop("done")
    return settled, going


_PERIOD = re.compile(r"([1-9]\d*) *(day|month|year)s?")


def parse_keep(text: str) -> tuple[str, int]:
    """all, last 100 or 18 months, as (kind, number)."""
    words = str(text).strip()
    if words == "all":
        return "all", 0
    last, period = re.fullmatch(r"last *([1-9]\d*)", words), _PERIOD.fullmatch(words)
    if not last and not period:
        raise OperatorError(f"cannot read {text!r}: write all, last N, or N days, months or years, e.g. last 100")
    return ("last", int(last[1])) if last else (period[2], int(period[1]))


def _period_start(text: Column, now: Column) -> Column:
    """`now` less a period (18 months); null where the text is no period."""
    form = r"\A([1-9][0-9]*) *(day|month|year)s?\z"
    n, unit = F.regexp_extract(text, form, 1).try_cast("int"), F.regexp_extract(text, form, 2)
    months = F.when(unit == "year", n * 12).when(unit == "month", n).otherwise(0)
    days = F.when(unit == "day", n).otherwise(0)
    back = now - F.make_ym_interval(F.lit(0), months) - F.make_dt_interval(days)
    return F.when(text.rlike(form), back)


def runs_to_forget(runs: DataFrame, keeps: DataFrame, now: dt.datetime, default_keep: str = DEFAULT_KEEP) -> DataFrame:
    """The finished runs that every start they count for lets go: run_id.

    `keeps`: flow_path, start, keep (all, last N, a period; null: the default period) and keep_failed. A run that counts
    for no start goes when it is older than the default period. How many of a start's runs are newer is a running count,
    carried across chunks of run numbers, so a start that has most of the runs is still many tasks."""
    kind, _ = parse_keep(default_keep)
    if kind in ("all", "last"):
        raise OperatorError(f"the default {default_keep!r} is no period: write N days, months or years")
    need_columns(keeps, ["flow_path", "start", "keep", "keep_failed"], "Keeps")
    clock = F.lit(now.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    text = F.trim(F.coalesce("keep", F.lit(default_keep)))
    last = F.regexp_extract(text, r"\Alast *([1-9][0-9]*)\z", 1).try_cast("bigint")
    known = (text == "all") | last.isNotNull() | _period_start(text, clock).isNotNull()
    rules = keeps.select("flow_path", "start", "keep_failed", F.assert_true(known, F.concat(F.lit("cannot read the keep "), text))
                         .alias("__ok"), last.alias("last_n"), _period_start(text, clock).alias("since"))
    rules = rules.where("__ok IS NULL").drop("__ok")
    finished = runs.where(col("status") != GOING).select("run_id", "flow_path", "status", "started", "counts_for")
    free = F.coalesce(F.col("counts_for"), F.lit("")) == ""
    default_since = _period_start(F.lit(default_keep), clock)
    loose = finished.where(free & (F.col("started") < default_since)).select("run_id")
    counted = finished.where(~free).withColumn("start", F.explode(F.split("counts_for", ", ")))
    ruled = counted.join(rules, ["flow_path", "start"])

    keyed = ruled.withColumns({KEY: key_of(["flow_path", "start"]), "__order": -F.col("run_id"), "__one": F.lit(1)})
    judged = running(keyed, KEY, ["__order"], {"__newer": ("sum", "__one")}, before=True)
    newer = F.coalesce(F.col("__newer"), F.lit(0))
    goes = (F.when(F.col("keep_failed") & (F.col("status") == "failed"), False)
            .when(F.col("last_n").isNotNull(), newer >= F.col("last_n"))
            .otherwise(F.coalesce(F.col("started") < F.col("since"), F.lit(False))))
    let_go = judged.withColumn("goes", goes).groupBy("run_id").agg(F.bool_and("goes").alias("goes"))
    return let_go.where("goes").select("run_id").unionByName(loose)


def retain(runs: DataFrame, keeps: DataFrame, now: dt.datetime, default_keep: str = DEFAULT_KEEP) -> DataFrame:
    """The runs that stay."""
    return runs.join(runs_to_forget(runs, keeps, now, default_keep), "run_id", "left_anti")


def step_durations(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per flow, step and day: the runs, the longest duration in seconds and the attempts, for detect_anomalies."""
    seconds = (micros(F.col("finished")) - micros(F.col("started"))) / 1_000_000
    done = _results(runs, steps).withColumns({"day": F.col("started").cast("date"), "__s": seconds})
    return done.groupBy("flow_path", "step", "day").agg(
        F.count("*").alias("runs"), F.max("__s").alias("seconds"), F.sum("attempts").alias("attempts"))


def search(versions: DataFrame, pattern: str, key: str, sources=("message", "outputs", "code", "file")) -> DataFrame:
    """Where a pattern is found: each key with the first of the sources (columns, best first) that has it: key, rank,
    found_in. An empty match is none."""
    need_columns(versions, [key, *sources], "Versions")
    hits = [F.when(F.exists(F.regexp_extract_all(col(s), F.lit(f"({pattern})"), F.lit(1)), lambda m: m != ""), F.lit(i))
            for i, s in enumerate(sources)]
    found = versions.groupBy(col(key)).agg(F.min(F.least(*hits) if len(hits) > 1 else hits[0]).alias("rank"))
    name = F.element_at(F.array(*[F.lit(s) for s in sources]), F.col("rank") + 1)
    return found.where("rank IS NOT NULL").select(key, "rank", name.alias("found_in"))
