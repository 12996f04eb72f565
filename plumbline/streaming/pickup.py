"""Files picked up as they arrive: each once, checked batch by batch, with a ledger of what came."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from ..errors import OperatorError
from ..operators.checks import check_table
from ..operators.ledger import Ledger
from ..sources.files import write_table


@dataclass
class Pickup:
    """A folder whose new files are read, checked and delivered, each file once."""

    spark: SparkSession
    folder: str
    schema: T.StructType | str
    checkpoint: str
    checks: list
    deliver_to: str  # a Parquet folder; a batch's rows are in its subfolder, so a batch done again replaces its own
    format: str = "parquet"
    ledger: Ledger | None = None
    flow: str = "pickup"
    options: dict | None = None
    on_failure: Callable | None = None  # called with (batch, check result) instead of raising

    def __post_init__(self):
        if self.format not in ("parquet", "csv", "json"):
            raise OperatorError(f"format {self.format!r} is none of parquet, csv, json")

    def run(self, max_files: int | None = None) -> None:
        """Pick up what is there now (Trigger.AvailableNow), then stop."""
        reader = self.spark.readStream.schema(self.schema).options(**(self.options or {}))
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        query = (reader.format(self.format).load(self.folder).writeStream.foreachBatch(self._batch)
                 .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()

    def _batch(self, df: DataFrame, batch: int) -> None:
        now = dt.datetime.now()
        found = check_table(df, self.checks, now=now)
        rows = None
        if found.passed:
            target = f"{self.deliver_to.rstrip('/')}/batch={batch}"
            write_table(df, target, "parquet")
            rows = df.sparkSession.read.parquet(target).count()  # (from the files' footers)
        if self.ledger is not None:
            self._record(batch, now, found, rows)
        if not found.passed:
            if self.on_failure is None:
                found.require()
            self.on_failure(batch, found)

    def _record(self, batch: int, now: dt.datetime, found, rows: int | None) -> None:
        status, done = "success" if found.passed else "failed", dt.datetime.now()
        part = json.dumps({"batch": batch, "of": self.checkpoint})
        run = self.ledger.run_number(self.flow, part)  # (a batch done again keeps its number)
        self.ledger.append("runs", [{"run_id": run, "flow": self.flow, "flow_path": self.flow, "params": part, "status": status,
                                     "started": now, "finished": done, "started_by": "pickup", "seq": 0}])
        self.ledger.append("steps", [{"run_id": run, "step": title, "status": outcome, "started": now, "finished": done,
                                      "attempts": 1, "error": None if outcome == "passed" else details, "rows": broken,
                                      "seq": i} for i, (title, outcome, broken, details) in enumerate(found.outcomes)])
        self.ledger.append("steps", [{"run_id": run, "step": "deliver", "status": status, "started": now, "finished": done,
                                      "attempts": 1, "rows": rows, "seq": len(found.outcomes)}])


def freshness_of_batches(ledger: Ledger) -> DataFrame:
    """Per batch: when it came, whether it passed and the rows it delivered."""
    delivered = ledger.state("steps").where("step = 'deliver'")
    runs = ledger.state("runs").where("started_by = 'pickup'").select("run_id", "flow", F.get_json_object("params", "$.batch").cast("bigint").alias("batch"))
    return delivered.join(runs, "run_id").select("flow", "batch", "run_id", "status", "started", "rows")
