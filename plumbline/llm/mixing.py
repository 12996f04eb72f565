"""Mixing sources to target weights.

The mix holds a set share of all words. Sources in code point order (null last) weigh by a repeating pattern; no target
exceeds a set multiple of its source, and what is cut off is shared anew by weight among the others.

A source's documents fall into blocks by a keyed hash, and its quota of block draws is exact: whole passes over all of
its blocks, then blocks in a permuted order as far as the target reaches. The block in which the target lies is split
into smaller blocks by a second hash, and the one of those in which it lies document by document, so that a target is
met to within half a document. No step needs more than the blocks of one source, the documents of one small block, or one
row per source.

A multivariate-hypergeometric splitting tree deals the draws out: the root holds every source's draws; each node gives
its left half of the output shards as many draws as their share, drawn without replacement over the sources, and the
rest to the right half. A leaf is a shard's quota of each source. Shards then take disjoint runs of each source's permuted
draws, and rows get a random place within their shard. All draws are keyed by `seed`, so reruns agree.

Sizes are words; null and empty texts have size 0 and are taken only with their block. Equal rows share their hashes and
stay equal rows. A document is taken as often as its source has passes, never more than `most` times."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .frames import cut, word_array

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCKS = 1024  # of a source, and of the block in which a target lies
SHARDS = 64


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """`total` shared by weight, no more than `most` times its size to any, the excess shared anew among the rest."""
    found, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] >= most * sizes[i] * weight]
        if not full:
            for i in open_:
                found[i] = left * weights[i] / weight
            break
        for i in sorted(full):
            found[i] = float(most * sizes[i])
            open_.discard(i)
        left -= math.fsum(found[i] for i in full)
        left = max(left, 0.0)
    return found


def split_tree(draws: Sequence[int], shards: int, seed: int = 0) -> np.ndarray:
    """How many of each source's draws each shard gets: (shards, sources), columns adding up to `draws`; shards get equal
    numbers of draws, but for one."""
    made = np.zeros((shards, len(draws)), np.int64)

    def part(held: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            made[first] = held
            return
        middle = (first + last) // 2
        wanted = int(held.sum()) * (middle - first) // (last - first)
        random = np.random.default_rng([seed, first, last])
        left, open_ = np.zeros_like(held), int(held.sum())
        for i, n in enumerate(held.tolist()):  # a multivariate hypergeometric draw, one source after the other
            open_ -= n
            left[i] = _hypergeometric(random, n, open_, wanted)
            wanted -= left[i]
        part(left, first, middle)
        part(held - left, middle, last)

    part(np.array(draws, np.int64), 0, shards)
    return made


def _hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, draws))
    share, n = good / (good + bad), good + bad  # beyond numpy's range: the normal law, kept within the possible
    spread = math.sqrt(draws * share * (1 - share) * (n - draws) / (n - 1))
    return int(min(good, draws, max(0, draws - bad, round(random.normal(draws * share, spread)))))


def _bucket(key: Column, salt: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _up_to(rows: DataFrame, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """`ends`: words of these rows up to and with this one, in order, for each source."""
    return rows.withColumn("ends", F.sum("words").over(W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
         share: float = SHARE, most: int = MOST, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: `key`, text_hash, source, size, source_size, target, `copies` (how often the mix takes
    it), `shards` (of each copy) and `places` (its order in the shard)."""
    sized = cut(docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("text_hash"), docs[source].alias("source"),
                            F.size(word_array(docs[text])).cast("bigint").alias("words"))
                .withColumns({"block": _bucket(F.struct("key", "text_hash"), 1, seed), "small": _bucket(F.struct("key", "text_hash"), 2, seed)}))
    by_block = cut(sized.groupBy("source", "block").agg(F.sum("words").alias("words"), F.count("*").alias("rows")))
    # one row per source; its name is only compared, as UTF-8 bytes, whose order is that of the code points
    known = by_block.groupBy("source").agg(F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r.words for r in known]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    passes = [min(most, int(t // s)) if s else 0 for t, s in zip(wanted, sizes)]
    rows = [(i, r.source, r.words, t, p, float(t - p * r.words)) for i, (r, t, p) in enumerate(zip(known, wanted, passes))]
    spark = docs.sparkSession
    sources = spark.createDataFrame(rows, "number int, source string, source_size bigint, target double, passes int, rest double")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # blocks in permuted order; the one in which what is left of the target ends, its small blocks, and so on to documents
    permuted = lambda *of: F.xxhash64(*of, F.lit(seed), F.lit(3))
    blocks = by_block.join(F.broadcast(sources), same(by_block, sources)).select("number", "rest", "passes", "block", "words", "rows")
    blocks = cut(_up_to(blocks.withColumn("turn", permuted("number", "block")), ["turn", "block"], ["number"]))
    whole = lambda: (F.col("ends") <= F.col("rest")) & (F.col("ends") - F.col("words") < F.col("rest"))
    inside = lambda: (F.col("ends") > F.col("rest")) & (F.col("ends") - F.col("words") < F.col("rest"))
    edge = blocks.where(inside()).select("number", "block", (F.col("rest") - F.col("ends") + F.col("words")).alias("rest"))
    numbered = sized.join(F.broadcast(sources), same(sized, sources)).select(sized["*"], "number", "source_size", "target", "passes")
    on_edge = cut(numbered.select("key", "text_hash", "words", "block", "small", "number").join(edge, ["number", "block"]))
    smalls = _up_to(on_edge.groupBy("number", "block", "rest", "small").agg(F.sum("words").alias("words"))
                    .withColumn("turn", permuted("number", "block", "small")), ["turn", "small"], ["number"])
    smalls = cut(smalls)
    last = smalls.where(inside()).select("number", "small", (F.col("rest") - F.col("ends") + F.col("words")).alias("rest"))
    single = on_edge.drop("rest").join(last, ["number", "small"]).withColumn("turn", permuted("number", "key", "text_hash"))
    single = _up_to(single, ["turn", "key", "text_hash"], ["number"])
    nearer = F.col("ends") - F.col("words") / 2 <= F.col("rest")  # a document is taken if that brings the sum nearer
    single = single.groupBy("number", "key", "text_hash").agg(F.min(nearer).alias("single"))  # (equal rows: all or none)

    taken = numbered.join(blocks.select("number", "block", whole().alias("by_block")), ["number", "block"])
    taken = taken.join(smalls.select("number", "block", "small", whole().alias("by_small")), ["number", "block", "small"], "left")
    taken = taken.join(single.select("number", F.col("key").alias("k"), F.col("text_hash").alias("h"), "single"),
                       (taken["number"] == single["number"]) & taken["key"].eqNullSafe(F.col("k")) & taken["text_hash"].eqNullSafe(F.col("h")), "left").drop(single["number"])
    extra = F.coalesce("by_block", F.lit(False)) | F.coalesce("by_small", F.lit(False)) | F.coalesce("single", F.lit(False))
    copies = F.col("passes") + F.when((F.col("passes") < most) & extra, 1).otherwise(0)

    # draws: every block once per pass, then the blocks within the rest (a split block is one more draw)
    counts = {r.number: (r.blocks, r.part) for r in blocks.groupBy("number").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("ends") - F.col("words") < F.col("rest")).alias("part")).collect()}
    drawn = [p * counts[i][0] + (counts[i][1] if p < most else 0) for i, p in enumerate(passes)]
    quotas = np.cumsum(split_tree(drawn, shards, seed), axis=0)  # shard s takes the draws from quotas[s - 1] to quotas[s]
    ranks = blocks.select("number", "block", F.row_number().over(W.partitionBy("number").orderBy("turn", "block")).alias("rank"),
                          F.count("*").over(W.partitionBy("number")).alias("blocks"))
    bounds = F.broadcast(spark.createDataFrame([(i, quotas[:, i].tolist()) for i in range(len(known))], "number int, bounds array<bigint>"))
    dealt = ranks.join(bounds, "number").select(
        "number", "block", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: F.size(F.filter(
            "bounds", lambda b: b < c * F.col("blocks") + F.col("rank")))).alias("dealt"))
    made = taken.withColumn("copies", copies).join(dealt, ["number", "block"])
    each = F.sequence(F.lit(1), F.lit(most))
    return made.select(F.col("key").alias(key), "text_hash", F.col("source").alias(source), F.col("words").alias("size"), "source_size", "target", "copies",
                       F.slice("dealt", 1, F.col("copies")).alias("shards"),
                       F.slice(F.transform(each, lambda c: F.xxhash64("key", "text_hash", c, F.lit(seed))), 1, F.col("copies")).alias("places"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with its columns, in shards and shuffled within."""
    planned = plan(docs, key, text, source, **settings).where("copies > 0")
    # (equal rows have equal plans: one per row of the join below)
    planned = planned.select(F.col(key).alias("own"), "text_hash", F.col(source).alias("of"), F.arrays_zip("shards", "places").alias("drawn")).dropDuplicates(["own", "text_hash", "of"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"), docs[source].alias("s"))
    met = rows.join(planned, F.col("k").eqNullSafe(F.col("own")) & (F.col("h") == F.col("text_hash")) & F.col("s").eqNullSafe(F.col("of")))
    drawn = met.select("row", F.explode("drawn").alias("drawn")).select("row", "drawn.shards", "drawn.places")
    return drawn.repartitionByRange("shards", "places").sortWithinPartitions("shards", "places").select("row.*")
