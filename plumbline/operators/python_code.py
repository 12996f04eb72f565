"""Your own Python over tables: whole-table functions, batches, and groups split into parts."""

from __future__ import annotations

import pickle
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col, need_columns
from ..functions.params import resolve
from ..plans.lineage import cut
from ..plans.ordered import CHUNK, CHUNK_ROWS, KEY, in_chunks, key_of
from ..sources.files import as_table

if TYPE_CHECKING:  # (tasks of other operators need no pandas, and the memory that it takes)
    import pandas as pd

SALTS = 64  # parts a group's partial results are merged in first
MOST_TOGETHER = 10_000  # rows of several groups that go on in one frame


@dataclass(frozen=True)
class Step:
    """A named transform to use many times: inputs, outputs and settings, each a default or (type, default) as a
    parameter's (text, int, float, bool, date, datetime, list)."""

    name: str
    fn: Callable
    inputs: tuple[str, ...] = ("table",)
    outputs: tuple[str, ...] = ("output",)
    settings: dict | None = None

    def __call__(self, inputs: dict[str, DataFrame] | DataFrame, **given):
        settings = self.settings or {}
        unknown = [s for s in given if s not in settings]
        if unknown:
            raise OperatorError(f"{self.name}: {', '.join(unknown)} is not a setting (its settings: {', '.join(settings)})")
        typed = {n: s for n, s in settings.items() if isinstance(s, tuple)}
        plain = {n: given.get(n, s) for n, s in settings.items() if n not in typed}
        values = {**plain, **resolve(typed, {n: v for n, v in given.items() if n in typed})}
        return run_python(self.fn, inputs, self.outputs, values, self.name, self.inputs)


def run_python(fn: Callable, inputs: dict[str, DataFrame] | DataFrame, outputs=("output",), settings: dict | None = None,
               name: str = "", wanted=None) -> dict:
    """Call fn(**inputs, **settings). It gives a frame (the first output) or a dict of outputs; frames become tables,
    other values stay; an output it does not set is left out."""
    if isinstance(inputs, DataFrame):
        inputs = {(wanted or ("table",))[0]: inputs}
    missing = [n for n in wanted or () if n not in inputs]
    if missing:
        raise OperatorError(f"{name or 'Python'}: no table for {', '.join(missing)}")
    try:
        made = fn(**inputs, **(settings or {}))
    except OperatorError:
        raise
    except Exception as e:
        at = traceback.extract_tb(e.__traceback__)[-1]
        raise OperatorError(f"{name or 'Python'}: line {at.lineno} of {at.name}: {type(e).__name__}: {e}") from e
    found = made if isinstance(made, dict) else {outputs[0]: made}
    unknown = [n for n in found if n not in outputs]
    if unknown and made is not found:
        raise OperatorError(f"{name or 'Python'}: {', '.join(unknown)} is not an output")
    spark = next((df.sparkSession for df in inputs.values()), None)

    def table(value):
        frame = hasattr(value, "columns") or type(value).__module__.startswith("pyarrow")
        return as_table(spark, value) if frame and spark is not None else value

    return {n: table(v) for n, v in found.items() if v is not None}


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """A pandas function over batches of rows: no task holds more than a batch."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(over, schema)


def per_group(df: DataFrame, by, partial: Callable[[pd.DataFrame], pd.DataFrame],
              merge: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Your own aggregate per group, for groups of any size. `partial` turns some rows of one group into a row (or a few)
    of `schema` (the group columns and the state); `merge` turns several such rows into fewer and may be called on
    what it gave before. Rows are reduced batch by batch where they are, a group's states are merged in up to 64 parts
    and then once more."""
    import pandas as pd

    by = [by] if isinstance(by, str) else list(by)
    need_columns(df, by, "Group by")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [partial(rows) for _, rows in batch.groupby(by, dropna=False, sort=False)]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    def folded(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in states:  # (a batch at a time: never a group's states at once)
            kept = merge(batch if kept is None else pd.concat([kept, batch], ignore_index=True))
        if kept is not None:
            yield kept

    folded.__annotations__ = {"states": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    states = df.mapInPandas(first, schema)
    names = states.columns
    # (a part is a function of the state's own values: a task done again puts it in the same part)
    salted = states.withColumn("__part", F.pmod(F.xxhash64(*[col(n) for n in names]), F.lit(SALTS)))
    parts = salted.groupBy(*[col(b) for b in by], "__part").applyInPandas(
        _dropping(folded, "__part"), schema)
    return parts.groupBy(*[col(b) for b in by]).applyInPandas(folded, schema)


def _dropping(fold: Callable, column: str) -> Callable:
    import pandas as pd

    def without(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold(batch.drop(columns=[column]) for batch in states)

    without.__annotations__ = {"states": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return without


def in_order(df: DataFrame, by, order, step: Callable, schema: str, start: Callable[[], object] = lambda: None,
             combine: Callable | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Your own Python over whole groups in order, of any size: step(state, frame) gets a group's rows in the order of the
    `order` columns, a batch at a time, and gives (state, frame); state begins as start() for each group. Gives the `by`
    columns, then `schema`. Memory is that of a batch and a state, never of a group. Rows equal in order come in any order:
    order by something unique.

    A group is one stream, since each state needs the one before. With `combine`, a group is cut into chunks of its order
    that run beside each other: each is run once from start() for the state it ends with, the states of a group's chunks
    are put together by combine(earlier, later), and each chunk is run again from what comes before it. So it must hold
    that running on from a state is the same as combining it with what start() leads to. Both runs call `step`."""
    import pandas as pd

    by, order = [by] if isinstance(by, str) else list(by), [order] if isinstance(order, str) else list(order)
    need_columns(df, [*by, *order], "In order")
    whole = df.withColumns({KEY: key_of(by)})
    taken = [c for c in T.StructType.fromDDL(schema).names if c in by]
    if taken:
        raise OperatorError(f"{', '.join(taken)} is a group column; the result has it already")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[col(b) for b in by]).schema)
    made = ", ".join(x for x in (kinds, schema) if x)
    names, columns = T.StructType.fromDDL(made).names, df.columns
    own = T.StructType.fromDDL(schema).names
    chunked, one = (whole.withColumn(CHUNK, F.lit(0)), True) if combine is None else in_chunks(whole, KEY, order, rows)
    marked = chunked.withColumns({"__state": F.lit(None).cast("binary"), "__mark": F.lit(1)})
    parts = [KEY, CHUNK]

    def sorted_parts(table: DataFrame) -> DataFrame:
        dealt = table.repartition(*parts).sortWithinPartitions(*parts, "__mark", *[col(o) for o in order])
        return dealt.withColumn("__part", F.xxhash64(*parts)).drop(KEY)

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        """Of each batch: its parts, as (part, whether it begins, what the chunks before lead to, where its rows are, its rows)."""
        last = None
        for batch in batches:
            ids, marks, rows = batch["__part"].to_numpy(), batch["__mark"].to_numpy(), batch[columns]
            cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
            found = []
            for at, end in zip(cuts, cuts[1:]):
                if at < end:
                    carry = batch["__state"].iloc[at] if marks[at] == 0 else None
                    some = rows.iloc[at + (carry is not None):end]
                    some.index = pd.RangeIndex(len(some))
                    found.append((ids[at], last != ids[at], carry, at, some))
                    last = ids[at]
            yield batch, found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch, parts_of in streams(batches):
            outs, places, kinds_of = [], [], None

            def together():  # (one frame of what many small groups gave: a frame costs more than its rows)
                made_of = pd.concat(outs, ignore_index=True)[own]
                for b in by:
                    made_of[b] = batch[b].iloc[places].reset_index(drop=True)
                return made_of[names]

            for _, begins, carry, at, some in parts_of:
                if begins:
                    state = start()
                if carry is not None:
                    state = pickle.loads(carry)
                if not len(some):
                    continue
                state, out = step(state, some)
                kinds_now = [out[c].dtype for c in own]
                if outs and (kinds_now != kinds_of or len(places) + len(out) > MOST_TOGETHER):
                    yield together()
                    outs, places = [], []
                outs.append(out)
                places.extend([at] * len(out))
                kinds_of = kinds_now
            if outs:
                yield together()

    if one:
        return sorted_parts(marked).mapInPandas(run, made)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for _, parts_of in streams(batches):
            for part, begins, _, _, some in parts_of:
                if begins:
                    if key is not None:
                        yield pd.DataFrame({"__part": [key], "__state": [pickle.dumps(state)]})
                    state, key = start(), part
                state, _ = step(state, some)
        if key is not None:
            yield pd.DataFrame({"__part": [key], "__state": [pickle.dumps(state)]})

    # Chunks are ranges, so at most one group goes on from each into the next: only groups of several chunks are run twice.
    several = F.broadcast(cut(chunked.groupBy(KEY).agg(F.min(CHUNK).alias("__from"), F.max(CHUNK).alias("__to")).where("__from < __to").select(KEY)))
    halved = chunked.join(several, KEY).select(chunked.columns)
    ended = sorted_parts(halved.withColumns({"__state": F.lit(None).cast("binary"), "__mark": F.lit(1)})).mapInPandas(ends, "__part bigint, __state binary")
    known = halved.select(*parts, *[col(b) for b in by]).groupBy(*parts).agg(F.count("*").alias("__n"), *[F.first(col(b)).alias(b) for b in by]).drop("__n").withColumn("__part", F.xxhash64(*parts))
    ended = cut(known.join(ended, "__part").drop("__part"))  # (a row per chunk of those groups)

    def carried(group: pd.DataFrame) -> pd.DataFrame:
        state, states = start(), []
        for end in group.sort_values(CHUNK)["__state"]:
            states.append(pickle.dumps(state))
            state = combine(state, pickle.loads(end))
        return group.sort_values(CHUNK).assign(__state=states)

    carries = ended.groupBy(F.xxhash64(KEY)).applyInPandas(
        lambda _, group: pd.concat([carried(g) for _, g in group.groupby(list(by), dropna=False)] if by else [carried(group)]), ended.schema)
    first = carries.withColumn("__mark", F.lit(0))
    return sorted_parts(first.unionByName(marked, allowMissingColumns=True).select(marked.columns)).mapInPandas(run, made)
