"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthonormal directions, shifted, quantised, and ordered along a Hilbert curve;
each of several curves has its own directions and shift. Every row is in every ordering, which Spark makes by ranges of
(curve, key). A query meets the window of its place on each curve, in whole blocks of BLOCK neighbouring rows; what its
windows hold is reranked by exact Euclidean distance in double precision, and the curves' answers are merged.

The curves are fitted on the driver on SAMPLE vectors (their scale), and so is the windows' reach: the least share of a
curve to either side with which sampled queries find TARGET of their true neighbours in the sample, and never less than
LEAST rows. Vectors without near neighbours (noise) thus get windows in proportion to the table, others narrow ones.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
with a null id. Equal vectors are indexed once, however many rows have them. Rows with the same id are the same row to a
query: it never meets itself, and an id is found once, at its least distance. Ties go to the smaller id. Empty tables give no rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranked import top_per_group
from ..sources.files import with_row_number
from .frames import cut

CURVES, DIRECTIONS, BITS = 24, 12, 4
BLOCK, LEAST = 512, 64
SAMPLE, ASKED, TARGET = 4096, 128, 0.93
SHARES = (0.0, 0.001, 0.002, 0.004, 0.008, 0.012, 0.018, 0.025, 0.035, 0.05, 0.07, 0.1, 0.15, 0.25, 0.5, 1.0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places along the Hilbert curve (signed 64-bit) of rows of cell numbers: each level's bits are rotated and
    reflected as the levels above it say, then read as a Gray code (Skilling's transposed form)."""
    x = cells.astype(np.int64)
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[:, i] & bit).astype(bool)
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


@dataclass
class Curves:
    directions: np.ndarray  # (curves, length, directions)
    low: np.ndarray  # (curves, directions)
    span: np.ndarray
    share: float  # of a curve, to either side of a query

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, curves)"""
        made = []
        for turn, low, span in zip(self.directions, self.low, self.span):
            cells = np.floor((vectors @ turn - low) / span * (1 << BITS))
            made.append(hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS))
        return np.stack(made, axis=1)


def fit(vectors: np.ndarray, found: int, curves: int = CURVES, seed: int = 0) -> Curves:
    """Curves for a sample of vectors, and the share of a curve that their queries need."""
    random = np.random.default_rng(seed)
    length = vectors.shape[1]
    n = min(DIRECTIONS, length)
    turns = np.stack([np.linalg.qr(random.normal(size=(length, n)))[0] for _ in range(curves)])
    seen = np.einsum("rl,cld->crd", vectors, turns)
    low, high = seen.min(axis=1), seen.max(axis=1)
    span = np.maximum(high - low, 1e-300) * 2  # the shift moves the data over twice their range
    low = low - random.uniform(0, 0.5, low.shape) * span
    made = Curves(turns, low, span, 1.0)
    rows = len(vectors)
    asked = np.arange(rows)[:: max(1, rows // ASKED)]
    apart = ((vectors[asked, None, :8] - vectors[None, :, :8]) ** 2).sum(axis=2) if length <= 8 else (
        (vectors[asked] ** 2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1) - 2 * vectors[asked] @ vectors.T)
    apart[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(apart, axis=1)[:, : min(found, rows - 1)]
    places = np.argsort(np.argsort(made.keys(vectors), axis=0, kind="stable"), axis=0)  # (rows, curves)
    steps = np.abs(places[true] - places[asked][:, None]).min(axis=2)  # the fewest rows between, over the curves
    for share in SHARES:
        made.share = share
        if not steps.size or (steps <= share * rows).mean() >= TARGET:
            break
    return made


def search(vectors: DataFrame, queries: Column, found: int = 10, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES) -> DataFrame:
    """(query_id, rank, <key>, score): for each row of `vectors` that `queries` picks its `found` nearest other rows, of
    all rows."""
    parts = vectors.select(vectors[key].cast("bigint").alias("id"), vectors[vector].cast("array<double>").alias("v"), queries.alias("asks"))
    parts = parts.where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    lengths = parts.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    schema = f"query_id bigint, rank int, {key} bigint, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    parts = cut(parts.where(F.size("v") == lengths[0].length).distinct())
    # equal vectors are one class, known by its least id and holding the few least ids that any answer can name
    named = top_per_group(parts.select("id", "v").distinct(), ["v"], [F.asc("id")], found + 1)
    ids = named.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(ids.join(parts.where("asks").select("v").distinct().withColumn("asks", F.lit(True)), "v", "left")
                  .withColumn("asks", F.coalesce("asks", F.lit(False))))
    total = classes.count()
    some = classes.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()
    index = fit(np.array([r.v for r in some]), found, curves)

    @F.arrow_udf("array<bigint>")
    def keys_of(rows: pa.Array) -> pa.Array:
        made = index.keys(rows.flatten().to_numpy().reshape(len(rows), -1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * made.shape[1], pa.int32()), pa.array(made.reshape(-1)))

    placed = classes.select("id", "v", "asks", F.posexplode(keys_of("v")).alias("curve", "place"))
    ordered = with_row_number(placed, "at", order_by=("curve", "place", "id"))  # (stored, in ranges of curve and key)
    at = F.col("at") - 1 - F.col("curve") * F.lit(total)
    ordered = ordered.select("curve", "id", "v", "asks", at.alias("at"))
    reach = max(LEAST, int(np.ceil(index.share * total)))
    block = lambda place: F.floor(place / BLOCK).cast("bigint")
    windows = F.sequence(block(F.greatest(F.col("at") - reach, F.lit(0))), block(F.least(F.col("at") + reach, F.lit(total - 1))))
    rows = ordered.select("curve", block(F.col("at")).alias("block"), "id", "v", F.lit(False).alias("asks"))
    asking = ordered.where("asks").select("curve", F.explode(windows).alias("block"), "id", "v", "asks")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        made = {"asker": [], "met": [], "score": []}
        ids, held = group["id"].to_numpy()[~asks], group["v"][~asks]
        if asks.any() and len(ids):
            held = np.stack(held.to_numpy())
            for query, value in zip(group["id"].to_numpy()[asks], group["v"][asks]):
                apart = np.sqrt(((held - value) ** 2).sum(axis=1))
                best = np.lexsort((ids, apart))[: found + 1]  # (its own class among them)
                made["asker"] += [query] * len(best)
                made["met"] += ids[best].tolist()
                made["score"] += apart[best].tolist()
        return pd.DataFrame(made)

    # a block has BLOCK classes, and the classes whose windows touch it and that hold a query
    met = rows.unionByName(asking).groupBy("curve", "block").applyInPandas(meet, "asker bigint, met bigint, score double")
    merged = met.groupBy("asker", "met").agg(F.min("score").alias("score"))
    nearest = top_per_group(merged, ["asker"], [F.asc("score"), F.asc("met")], found + 1).select("asker", "met", "score")
    near_ids = nearest.join(classes.select(F.col("id").alias("met"), "ids"), "met").select("asker", "score", F.explode("ids").alias(key))
    near_ids = top_per_group(near_ids, ["asker"], [F.asc("score"), F.asc(key)], 2 * found + 1, "place").drop("place")
    asked = parts.where("asks").select(F.col("id").alias("query_id"), "v").join(classes.select(F.col("id").alias("asker"), "v"), "v").drop("v")
    others = asked.join(near_ids, "asker").where(F.col("query_id") != F.col(key)).groupBy("query_id", key).agg(F.min("score").alias("score"))
    return top_per_group(others, ["query_id"], [F.asc("score"), F.asc(key)], found).select("query_id", "rank", key, "score")
