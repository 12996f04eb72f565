"""Groups of linked things: links found in buckets, and the connected groups they form, all as DataFrames.

Ids are 64-bit integers. Nothing here lists all pairs of a bucket that holds one group, and nothing is collected. Joins ask
for sort-merge joins: Spark takes the output of Python steps and of explode for as large as their input, and may broadcast
what is some seventy times as large."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .frames import cut, forget, parts_of

MOST_ROUNDS = 60  # far beyond what 2^60 nodes in one chain would take
PART_ROWS, MOST_PARTS = 2_000_000, 8  # rows of stored buckets that are joined at a time, as long as that is in so many parts


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that it reaches. Alternating large and small
    stars: links move to ever smaller ids until each group is one star. A link of an id to itself only names the id."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(done)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked_in_buckets(keyed: DataFrame, prints: DataFrame | None, near: Callable[[Column, Column], Column],
                      verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) for the ids with links: two ids that share a bucket are linked if `near` holds for their
    fingerprints and `verify`, where given, keeps their pair.

    `keyed` has (key, id, print), in any number, and the print of `prints` (id, print) for each id; `prints` is None if an
    id is its own fingerprint (and `keyed` has only key and id). `verify` gets distinct pairs (a, b), stored, and returns
    those that hold, stored; `keyed` is stored then, too, and is forgotten here, as the pairs may be by `verify`.

    First every member of a bucket is tried against the bucket's least id, which costs a pair per member however large
    the bucket; a bucket of two is done with that. What is joined then needs no other pair: only members outside their
    bucket's largest group are tried against the rest of the bucket, so no link between different groups is lost. Where
    pairs are verified, one that shares several buckets is made in the first of them only.

    Stored buckets are gone through in parts of some PART_ROWS rows (MOST_PARTS at most): the shuffles of one part are on
    disk at a time."""
    parts = lambda table: 1 if verify is None else max(1, min(MOST_PARTS, math.ceil(table.count() / PART_ROWS)))
    stored = verify or cut
    kept = cut(*[_tried(part, prints is None, near) for part in parts_of(keyed, "key", parts(keyed))])
    forget(keyed)
    leading = kept.where("close").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(leading if verify is None else cut(leading))
    groups = connected(links)
    forget(links)

    several = kept.where("n > 2").select("key", "id", "print")
    mixed = cut(*[_mixed(part, groups) for part in parts_of(several, "key", parts(several))])
    forget(kept)
    n = parts(mixed)
    if verify is not None:
        placed, mixed = mixed, cut(*map(with_earlier, parts_of(mixed, "id", n)))
        forget(placed)
    across = [pairs_across(part, near) for part in parts_of(mixed, "key", n)]
    more = stored(across[0].distinct() if verify is None else cut(*across))  # (with_earlier: a pair comes up once in all parts)
    forget(mixed)
    found = connected(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    forget(more)
    return found


def _tried(keyed: DataFrame, own_print: bool, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Members of buckets of two and more beside the least id of the bucket, `close` to it or not."""
    if own_print:
        keyed = keyed.withColumn("print", F.col("id"))
        least = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).withColumn("leads", F.col("leader"))
    else:  # (an id has one print, which comes with it)
        first = keyed.groupBy("key").agg(F.min(F.struct("id", "print")).alias("first"), F.count("*").alias("n"))
        least = first.select("key", F.col("first.id").alias("leader"), F.col("first.print").alias("leads"), "n")
    tried = keyed.join(least.where("n > 1").hint("merge"), "key")
    close = (F.col("id") != F.col("leader")) & near(F.col("print"), F.col("leads"))
    return tried.withColumn("close", close).where("close OR n > 2").select("key", "id", "print", "leader", "n", "close")


def _mixed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold several groups, with their own (`component`) and the bucket's largest (`main`)."""
    placed = kept.join(groups.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("groups"))
    return placed.join(main.where("groups > 1").drop("groups").hint("merge"), "key").select("key", "id", "print", "component", "main")


def with_earlier(mixed: DataFrame) -> DataFrame:
    """With `earlier`: the lesser keys of the row's id."""
    return mixed.withColumn("earlier", F.collect_list("key").over(W.partitionBy("id").orderBy("key").rowsBetween(W.unboundedPreceding, -1)))


def pairs_across(mixed: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b), a < b, of ids near each other that share a key but no component. `mixed` has key, id, print, component
    and main, the key's largest component; with `earlier` a pair comes up once, at the least key that both have."""
    once = "earlier" in mixed.columns
    own = lambda side, *more: mixed.select("key", F.col("id").alias(side), F.col("print").alias(f"p{side}"), F.col("component").alias(f"c{side}"),
                                           *[F.col("earlier").alias(f"e{side}")] * once, *more)
    a, b = own("a", "main").where("ca <> main").drop("main"), own("b", "main")
    other = (F.col("cb") == F.col("main")) | (F.col("ca") < F.col("cb"))
    met = (a["key"] == b["key"]) & near(F.col("pa"), F.col("pb")) & other & (F.col("ca") != F.col("cb"))
    pairs = a.join(b.hint("merge"), met & ~F.arrays_overlap("ea", "eb") if once else met)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
