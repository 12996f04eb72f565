"""Labelled rows that a classifier learns from, and those held out from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: Column, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the key as text leaves `part` when divided by `parts`; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column], per_class: int, features: Column,
           key: str = "doc_id") -> list[tuple]:
    """(features, label) of at most `per_class` labelled rows of either class, chosen by a hash of their keys among those
    that `learn` allows. Both the rows and what is collected of each are bounded, whatever the tables hold."""
    known = labels.select(labels[key].alias("own"), labels[label].cast("int").alias("label")).where(F.col("own").isNotNull() & learn(F.col("own")))
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).distinct().orderBy(F.xxhash64("own"), "own").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    met = docs.join(F.broadcast(chosen), docs[key] == F.col("own"))  # (at most 2 * per_class rows)
    picked = met.select(F.xxhash64("own").alias("turn"), "own", "label", features.alias("features"))
    rows = picked.orderBy("turn", "own", "label").limit(2 * per_class).collect()
    return [(r.features, r.label) for r in rows]
