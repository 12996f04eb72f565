"""The trie of shared beginnings of conversations, by fixed-length block hashing.

A node of depth d stands for one sequence of d first turns (role and text), its members are the conversations that
start with it, and the root, of depth 0, has them all. Conversations are cut into blocks of `block` turns. A block's
digest is the sum of its turns' digests, each salted with the turn's place, so a running sum over blocks is the digest of
everything up to a block's end. Conversations are grouped by the digests before and after each block: a pair of digests
is one row however many conversations share it. Where all that go on from a digest go on with the same block, every turn
of it is a node with the same members, and nothing else is looked at. Only blocks whose siblings diverge are refined to
the turn at which they part.

Sums over subtrees need no walk of the tree. Every node belongs to its smallest member, and what one conversation owns is
a chain of nodes down to its own end; so a subtree's sum is that of its members' chains, less what the smallest of them owns
above the node. Nothing is collected and no step goes depth by depth.

Digests are 128 bits; two sequences are taken as one only if both halves agree. Rows without a key take no part. Turns go
by their number, null first, and among equal numbers by the digests of role and text. A null role or text counts as
empty. Equal rows are turns of their own. A table without conversations gives no rows. Other columns play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import running
from .frames import cut, word_array

BLOCK = 4  # turns
IDS = 4096  # consecutive keys whose ends are written as one piece of text
NO_TURNS = "cast(0 as decimal(38,0))"


def read_turns(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, num, d1, d2, words): every turn's place from 1, digest and number of words; texts go no further than this."""
    said, by = F.coalesce(table[text], F.lit("")), F.coalesce(table[role], F.lit(""))
    turns = table.where(table[key].isNotNull()).select(
        table[key].cast("bigint").alias("conv"), table[turn].alias("turn"), F.xxhash64(by, said).alias("d1"),
        F.xxhash64(F.lit("second"), said, by).alias("d2"), F.size(word_array(said)).cast("bigint").alias("words"),
        F.lit(1).cast("bigint").alias("one"), F.monotonically_increasing_id().alias("place"))
    made = running(turns, "conv", ["turn", "d1", "d2", "place"], {"num": ("sum", "one")})
    return made.select("conv", "num", "d1", "d2", "words")


def share_openings(turns: DataFrame, opening: Column, source: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that each starts with the first turns of another: the first `opening` (of `conv`; at most
    `most`, a small number) turns of the conversation `source` (of `conv`), then its own after as many. (turns, conversations)"""
    turns = cut(turns)
    convs = turns.select("conv").distinct().withColumns({"h": opening, "source": source})
    heads = turns.where(F.col("num") <= most).groupBy(F.col("conv").alias("source")).agg(
        F.sort_array(F.collect_list(F.struct("num", "d1", "d2", "words"))).alias("head"))
    rebuilt = cut(convs.join(heads, "source", "left").select("conv", "h", F.slice(
        F.coalesce("head", F.array().cast("array<struct<num: bigint, d1: bigint, d2: bigint, words: bigint>>")), F.lit(1), F.col("h")).alias("head")))
    taken = rebuilt.select("conv", F.inline("head"))
    own = turns.join(rebuilt.select("conv", "h", F.size("head").alias("kept")), "conv").where("num > h")
    own = own.select("conv", (F.col("num") - F.col("h") + F.col("kept")).alias("num"), "d1", "d2", "words")
    return taken.unionByName(own), rebuilt.select("conv")


def _digest(a: Column, b: Column) -> Column:
    return F.struct(a.cast("decimal(38,0)").alias("s1"), b.cast("decimal(38,0)").alias("s2"))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv, depth, before, after, turns): a row per conversation and block, `depth` that of its last turn."""
    salted = turns.select("conv", F.floor((F.col("num") - 1) / block).cast("bigint").alias("b"), F.struct(
        "num", F.xxhash64("num", "d1", "d2").alias("t1"), F.xxhash64("d2", "num", "d1").alias("t2"), "words").alias("turn"))
    met = salted.groupBy("conv", "b").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.sum(F.col("turn.t1").cast("decimal(38,0)")).alias("in1"),
        F.sum(F.col("turn.t2").cast("decimal(38,0)")).alias("in2"))
    upto = running(cut(met), "conv", ["b"], {"s1": ("sum", "in1"), "s2": ("sum", "in2")})
    return upto.select("conv", F.element_at("turns", -1)["num"].alias("depth"), "turns",
                       _digest(F.col("s1") - F.col("in1"), F.col("s2") - F.col("in2")).alias("before"), _digest(F.col("s1"), F.col("s2")).alias("after"))


def _by_turn(shared: DataFrame, *values: str) -> DataFrame:
    """The turns of shared blocks: (parent, digest, depth, words) and the blocks' `values`."""
    start = F.struct(F.col("before").alias("digest"), F.array().cast("array<struct<parent: struct<s1: decimal(38,0), s2: decimal(38,0)>, "
                     "digest: struct<s1: decimal(38,0), s2: decimal(38,0)>, depth: bigint, words: bigint>>").alias("nodes"))

    def step(sofar: Column, turn: Column) -> Column:
        here = _digest(sofar["digest"]["s1"] + turn["t1"], sofar["digest"]["s2"] + turn["t2"])
        node = F.struct(sofar["digest"].alias("parent"), here.alias("digest"), turn["num"].alias("depth"), turn["words"].alias("words"))
        return F.struct(here.alias("digest"), F.concat(sofar["nodes"], F.array(node)).alias("nodes"))

    return shared.select(*values, F.inline(F.aggregate("turns", start, step)["nodes"]))


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; what is held is a node's state, not its pieces."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node or state is None:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "sha": [d[1] for d in done]}, pa.schema([("node", pa.string()), ("sha", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "sha": [state.hexdigest()]}, pa.schema([("node", pa.string()), ("sha", pa.string())]))


def _name(digest: Column) -> Column:
    return F.concat_ws("/", digest["s1"], digest["s2"])


def _ends(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): of the keys, ascending and comma-joined, of the conversations (conv, digest) that end there.
    Keys are joined in pieces, by ranges of keys; a hash needs its input in order, so a node's pieces (not its conversations)
    pass through one task, which holds one of them at a time."""
    pieces = ends.groupBy("digest", F.floor(F.col("conv") / IDS).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    alone = pieces.groupBy("digest").agg(F.count("*").alias("n"), F.max("text").alias("text"))
    single = alone.where("n = 1").select("digest", F.sha2("text", 256).alias("ends_sha256"))
    many = alone.where("n > 1").select("digest")
    rest = pieces.join(many, "digest").select(_name(F.col("digest")).alias("node"), "part", "text")
    hashed = rest.repartition("node").sortWithinPartitions("node", "part").select("node", "text").mapInArrow(_hash_texts, "node string, sha string")
    named = many.withColumn("node", _name(F.col("digest"))).join(hashed, "node").select("digest", F.col("sha").alias("ends_sha256"))
    return single.unionByName(named)


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of `turns` (conv, num, d1, d2, words; numbers from 1 without gaps) over the
    conversations `convs` (conv), which may have no turns: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (words of the last text, once for each member but one, summed over the subtree) and
    ends_sha256."""
    blocks = cut(_blocks(turns, block))
    shared = cut(blocks.groupBy("before", "after").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("turns").alias("turns")))
    ways = shared.groupBy("before").agg(F.min("after").alias("least"), F.max("after").alias("most"))
    ways = ways.select("before", (F.col("least") != F.col("most")).alias("diverge"))
    placed = shared.join(ways, "before")
    paths = _by_turn(placed.where("NOT diverge"), "n", "conv")
    parted = _by_turn(placed.where("diverge"), "n", "conv").groupBy("digest").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), *[F.first(c).alias(c) for c in ("parent", "depth", "words")])
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0").select(
        "n", "conv", F.expr(f"struct({NO_TURNS} as s1, {NO_TURNS} as s2)").alias("digest"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("words"))
    below = paths.unionByName(parted)
    nodes = below.unionByName(root, allowMissingColumns=True).withColumn("saves", (F.col("n") - 1) * F.col("words"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))

    owned = cut(nodes.groupBy("conv").agg(F.sum("saves").alias("saves"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves")))
    over_blocks = blocks.select("conv", "before", "after").join(owned, "conv").groupBy("before", "after").agg(
        F.sum("saves").alias("saves"), F.sum("leaves").alias("leaves"))
    in_subtree = _by_turn(shared.join(over_blocks, ["before", "after"]), "saves", "leaves").groupBy("digest").agg(
        F.sum("saves").alias("all_saves"), F.sum("leaves").alias("n_leaves"))
    of_all = owned.agg(F.sum("saves").alias("all_saves"), F.sum("leaves").alias("n_leaves"))
    totals = in_subtree.unionByName(root.select("digest").crossJoin(of_all))  # (one row each)

    last = blocks.groupBy("conv").agg(F.max_by("after", "depth").alias("digest"))
    ended = convs.join(last, "conv", "left").select("conv", F.coalesce("digest", F.expr(f"struct({NO_TURNS} as s1, {NO_TURNS} as s2)")).alias("digest"))
    chains = running(nodes, "conv", ["depth"], {"upto": ("sum", "saves")})
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = chains.join(totals, "digest").join(_ends(ended), "digest", "left").join(parents, "parent", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("all_saves") - F.col("upto") + F.col("saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
