"""Packing documents into training sequences of like cost.

A sequence has room for `length` ids. Reading a piece of n ids in it costs n + QUADRATIC * n * n: what every id costs, and
what attention within the piece does. A document longer than a sequence first fills whole sequences of its own; what then
remains of it is packed. Remainders are dealt by a salted hash of their key to blocks of some thousand documents, and
each block is packed by itself: its remainders go, longest first, to the sequence of the lowest cost that has room left for
them. What fits nowhere whole is cut in the end: it fills the sequence with the most room, and goes on in the next.

A block has as many sequences as its ids fill, and its last ids make sequences whose lengths are powers of two (which need
no padding), so no id of padding is written. Documents are encoded once; only the remainders' ids, counts and checksums are
shuffled. The salt is a row's place in its input, so rows with one key are spread over the blocks as well, and a task done
again deals them the same way.

Null and empty texts have the end id alone. Equal rows are packed each for itself, as are rows without a key. A table
without rows gives none. Other columns play no part."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .frames import map_slices
from .library_ids import encoder, share, texts_of

LENGTH = 1024
QUADRATIC = 1 / 2048  # of a sequence of 1024 ids, attention costs half of what its ids do
BLOCK = 4096  # documents, about
ROWS = 1024  # texts encoded together
IN_BLOCK = 1 << 32  # sequence numbers of a block


def rooms(total: int, length: int) -> list[int]:
    """The sequences that `total` ids fill exactly: as many of `length` as go, the rest in falling powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << bit for bit in range(length.bit_length(), -1, -1) if rest >> bit & 1]


def assign(sizes: np.ndarray, length: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, first id, ids, sequence, offset in it) of each piece of documents of these sizes, by the rule above. The
    longest document goes first, of equal ones the earlier; of equal costs or rooms the earlier sequence is taken."""
    room = np.array(rooms(int(sizes.sum()), length), np.int64)
    used, cost, made = np.zeros_like(room), np.zeros(len(room)), []

    def put(doc: int, first: int, ids: int, to: int) -> None:
        made.append((doc, first, ids, to, int(used[to])))
        used[to] += ids
        room[to] -= ids
        cost[to] += ids + quadratic * ids * ids

    cut = []
    for doc in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[doc])
        if not size:
            break
        fits = np.where(room >= size, cost, np.inf)
        to = int(fits.argmin())
        if fits[to] < np.inf:
            put(doc, 0, size, to)
        else:
            cut.append((doc, size))
    for doc, size in cut:
        first = 0
        while first < size:
            to = int(room.argmax())
            ids = min(size - first, int(room[to]))
            put(doc, first, ids, to)
            first += ids
    return made


def _encode(docs: DataFrame, tokenizer: str, length: int, end_id: int, key: str, text: str) -> DataFrame:
    """(key, doc_tokens, full: checksums of the sequences that a document fills alone, rest: the ids after them, place)"""
    shared, kind = share(docs, tokenizer), docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        ids, counts = encoder(shared).encode(texts_of(batch.column(1)))
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        sizes, full, rest = counts + 1, [], []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            own = ids[end - size:end]
            alone = size // length * length
            full.append([zlib.crc32(own[at:at + length]) for at in range(0, alone, length)])
            rest.append(own[alone:].tobytes())
        return [batch.column(0), sizes, full, rest, batch.column(2)]

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.monotonically_increasing_id().alias("place"))
    return map_slices(pairs, f"key {kind}, doc_tokens bigint, full array<bigint>, rest binary, place bigint", run, ROWS)


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, quadratic: float) -> Iterator[pa.RecordBatch]:
    """The pieces of each block; rows come block by block, and what is held is one block."""
    held: list[tuple] = []

    def pieces() -> pa.RecordBatch:
        block, out = held[0][0], []
        sizes = np.array([len(row[4]) // 4 for row in held], np.int64)
        number = block * IN_BLOCK
        for _, key, tokens, full, _ in held:
            for i, check in enumerate(full):
                out.append((key, i * length, length, check, tokens, number, 0))
                number += 1
        for doc, first, ids, sequence, offset in assign(sizes, length, quadratic):
            _, key, tokens, full, rest = held[doc]
            out.append((key, len(full) * length + first, ids, zlib.crc32(rest[4 * first:4 * (first + ids)]), tokens, number + sequence, offset))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield pieces()
                held.clear()
            held.append(row)
    if held:
        yield pieces()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, quadratic: float = QUADRATIC, block: int = BLOCK,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: the key, start (the document's ids before it), length, ids_crc32, doc_tokens (with the end id),
    sequence_id and offset (in its sequence). Ids are the tokenizer file's (its path on the driver), `end_id` last."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = max(1, math.ceil(docs.count() / block))
    rows = _encode(docs, tokenizer, length, end_id, key, text)
    turn = F.xxhash64("key", "place")
    dealt = rows.select(F.pmod(turn, F.lit(blocks)).alias("block"), "key", "doc_tokens", "full", "rest", turn.alias("turn"), "place")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "turn", "place").drop("turn", "place")
    schema = StructType.fromDDL(f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _pack(batches, to_arrow_schema(schema), length, quadratic)

    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key)
