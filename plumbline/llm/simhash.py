"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code of length 23 has a codeword within
3 bits of every word of 23 bits. For a segment (with zeros before it) the home key is the index of its nearest codeword;
its keys are the home keys of itself and of all segments one bit away: one or about six. So of two segments at most one
bit apart, each one's home key is among the other's keys.

Three differing bits fall on the segments, in some order, as (3, 0, 0), (2, 1, 0) or (1, 1, 1), or fewer. Hence two such
fingerprints share a bucket of one of these kinds:
- two segments as they are (the third may differ in any bits);
- one segment as it is and a key of another (the third may differ in any bits);
- a key of each segment: keys of the first two beside the home of the third, against homes of the first two beside keys
  of the third.
Members of a bucket are verified by their differing bits (see components.linked_in_buckets).

Words are lower-cased in A-Z alone. A text with fewer words than a shingle is one shingle; without words, null included,
its fingerprint is zero and links like any other. Rows equal in key and text share their fate, whatever else they hold."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import bits_apart, linked_in_buckets
from .frames import cut, map_slices

SHINGLE, MOST_BITS, SEED = 3, 3, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11  # the polynomial of the binary Golay code
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = 4096  # shingles whose bits are counted at once
PRINTS, AT_ONCE = 32_768, 1024  # fingerprints a task makes keys of (some 70 each), and how many of them at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[shingle - 1 :] - 1).tolist() or [len(joined)]
    first = [0, *ends[: len(last) - 1].tolist()]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), BLOCK):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


@cache
def _syndromes() -> np.ndarray:
    """The 11 check bits of each value of each byte of a 23-bit word (they are linear in its bits)."""
    of_bit = []
    for i in range(LENGTH):
        rest = 1 << i
        for j in range(LENGTH - 1, CHECKS - 1, -1):
            if rest >> j & 1:
                rest ^= GENERATOR << (j - CHECKS)
        of_bit.append(rest)
    table = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and byte * 8 + i < LENGTH:
                    table[byte, value] ^= of_bit[byte * 8 + i]
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    table = _syndromes()
    return table[0][words & 255] ^ table[1][words >> 8 & 255] ^ table[2][words >> 16 & 127]


@cache
def _errors() -> np.ndarray:
    """The only error of at most 3 bits for each of the 2,048 check values."""
    masks = np.array([sum(1 << i for i in bits) for n in range(4) for bits in combinations(range(LENGTH), n)], np.int32)
    errors = np.full(1 << CHECKS, -1, np.int32)
    errors[_syndrome(masks)] = masks
    return errors


def home(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word: its bits above the check bits."""
    return (words ^ _errors()[_syndrome(words)]) >> CHECKS


def keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of segments, the home key in the first column, and which of them to use (each once per segment)."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    found = home(segment[:, None] ^ flips)
    rest = np.sort(found[:, 1:], axis=1)
    fresh = np.ones_like(rest, bool)
    fresh[:, 1:] = rest[:, 1:] != rest[:, :-1]
    fresh &= rest != found[:, :1]
    return np.concatenate([found[:, :1], rest], axis=1), np.concatenate([np.ones((len(segment), 1), bool), fresh], axis=1)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of `prints`) for every bucket of every fingerprint (unsigned 64-bit). The kind is above bit 48."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int32) for low, n in SEGMENTS]
    made: list[np.ndarray] = []
    whose: list[np.ndarray] = []

    def put(kind: int, payload: np.ndarray, rows: np.ndarray) -> None:
        made.append(payload | np.int64(kind) << 48)
        whose.append(rows)

    every = np.arange(len(prints))
    listed = []
    for part, (_, bits) in zip(parts, SEGMENTS):
        found, used = keys(part, bits)
        rows, columns = np.nonzero(used)
        listed.append((found[:, 0].astype(np.int64), rows, found[rows, columns].astype(np.int64)))
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(kind, parts[i].astype(np.int64) << 22 | parts[j], every)
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 3):
        _, rows, near = listed[j]
        put(kind, parts[i][rows].astype(np.int64) << 12 | near, rows)
    (_, a_rows, a_keys), (_, b_rows, b_keys), (c_home, c_rows, c_keys) = listed
    starts, counts = np.searchsorted(b_rows, every), np.bincount(b_rows, minlength=len(prints))
    times = counts[a_rows]  # each key of the first segment meets all keys of the second
    rows, firsts = np.repeat(a_rows, times), np.repeat(a_keys, times)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    put(9, firsts << 24 | b_keys[starts[rows] + within] << 12 | c_home[rows], rows)
    put(9, listed[0][0][c_rows] << 24 | listed[1][0][c_rows] << 12 | c_keys, c_rows)
    return np.concatenate(made), np.concatenate(whose)


def near(a: Column, b: Column) -> Column:
    return bits_apart(a, b) <= MOST_BITS


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: its `key`, `text_hash` (64 bits), `print` (signed), and `component`: the least key of
    those it reaches by links of at most three bits, its own included (nulls only where all keys of a group are)."""
    prints = cut(docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("text_hash"), fingerprint_column(docs[text], shingle).alias("print")))
    different = cut(prints.groupBy("print").agg(F.min("key").alias("least")))

    def run(batch: pa.RecordBatch) -> list:
        values = batch.column(0).to_numpy()
        made, whose = bucket_keys(values.view(np.uint64))
        return [pa.array(made), pa.array(values[whose])]

    tasks = max(1, math.ceil(different.count() / PRINTS))  # (else as few as hold the fingerprints, which take far less room than their keys)
    keyed = map_slices(different.select("print").repartition(tasks, "print"), "key bigint, id bigint", run, AT_ONCE)
    groups = linked_in_buckets(keyed, None, near)
    named = different.join(groups.withColumnRenamed("id", "print"), "print", "left").withColumn("group", F.coalesce("component", "print"))
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    of_print = named.select("print", "group").join(least, "group").select("print", "component")
    return prints.join(of_print, "print").select(F.col("key").alias(key), "text_hash", "print", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the least key stays (of rows with that key
    the one with the least text hash; of equal rows one). Columns stay as they were. Rows with a null key stand last."""
    found = cut(near_duplicates(docs, key, text, shingle).withColumn("group", F.struct("component", F.when(F.col("component").isNull(), F.col("print")))))
    order = F.struct(F.col(key).isNull(), key, "text_hash")
    first = found.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    stay = cut(first.select(F.col(f"first.{key}").alias("stay_key"), F.col("first.text_hash").alias("stay_hash")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("own_key"), F.xxhash64(docs[text]).alias("own_hash"))
    kept = rows.join(stay, F.col("own_key").eqNullSafe(F.col("stay_key")) & (F.col("own_hash") == F.col("stay_hash")), "left_semi")
    twice = found.groupBy(key, "text_hash").count().where("count > 1").select(F.col(key).alias("stay_key"), F.col("text_hash").alias("stay_hash"))
    if not twice.join(stay, F.struct(stay["stay_key"], stay["stay_hash"]).eqNullSafe(F.struct(twice["stay_key"], twice["stay_hash"])), "left_semi").isEmpty():
        kept = kept.dropDuplicates(["own_key", "own_hash"])  # (the whole rows are shuffled only where rows repeat)
    return kept.select("row.*")
