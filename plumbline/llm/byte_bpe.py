"""Byte-level BPE: texts to token ids and back.

Merges are driven by a rank queue: one bucket per merge rank holds the places (of a linked list over the bytes) where
that merge can be made, a bitmap in three levels of 64 tells which buckets have any, and find-first-set gives the next
rank. Entries made stale by a merge beside them stay and are skipped when met. The pre-tokens of many texts share one
queue, so that a step merges one rank in all of them.

Null and empty texts give no ids. A text of any length is encoded whole; equal texts give equal ids."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_slices
from .pieces import Pieces

BLOCK = 1_000_000  # bytes of pre-tokens merged at once, but for a longer single one
ROWS = 1024  # texts encoded together
MEMO = 300_000  # words that a task remembers at most


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Places by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def put(self, rank: int, places: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(places)
            return
        self.buckets[rank] = [places]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Each place to the bucket of its rank; those of rank -1 go nowhere."""
        has = ranks >= 0
        ranks, places = ranks[has], places[has]
        if len(ranks) < 2:
            if len(ranks):
                self.put(int(ranks[0]), places)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        ends = [*cuts.tolist(), len(ranks)]
        start = 0
        for rank, end in zip(ranks[[0, *cuts]].tolist(), ends):
            self.put(rank, places[start:end])
            start = end

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and all its places; only where `top` is not 0."""
        at = (self.top & -self.top).bit_length() - 1
        word = self.mid[at]
        at = at << 6 | (word & -word).bit_length() - 1
        word = self.low[at]
        rank = at << 6 | (word & -word).bit_length() - 1
        self.low[at] = word = word & (word - 1)
        if not word:
            self.mid[rank >> 12] &= ~(1 << (at & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class ByteBpe:
    """A vocabulary as ranks: every single byte has one, and a pair merges if its joined bytes have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, the first of them {missing[0]}")
        self.ranks, size = ranks, max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.queue = RankQueue(size)
        pairs = [(ranks[t[:i]] * size + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.size = keys[order], values[order].astype(np.int32), size
        self.pieces = Pieces(self._ids, regex.compile(pattern).findall, MEMO)

    def _ids(self, matches: list[str]) -> list[bytes]:
        pieces = [m.encode("utf-8", "surrogatepass") for m in matches]
        done = [self.ranks.get(p) for p in pieces]
        left = [p for p, rank in zip(pieces, done) if rank is None]
        merged: list[bytes] = []
        at = 0
        while at < len(left):  # blocks of about a million bytes
            stop, held = at, 0
            while stop < len(left) and (stop == at or held + len(left[stop]) <= BLOCK):
                held += len(left[stop])
                stop += 1
            merged += self.merge(left[at:stop])
            at = stop
        rest = iter(merged)
        return [next(rest) if rank is None else rank.to_bytes(4, "little") for rank in done]

    def _rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of two tokens joined, -1 where they don't join (or one of them is -1, a border)."""
        keys = first.astype(np.int64) * self.size + second
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (first >= 0) & (second >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens. Their bytes stand in one linked list, with a border after each, and share the queue.

        The pre-tokens don't touch, so the lowest rank of all is merged in all of them at once. What is left of its bucket
        goes back to it."""
        sizes = np.array([len(p) for p in pieces])
        starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # place 0 is a border too
        n = int(starts[-1])
        token = np.full(n, -1, np.int32)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        inside = np.arange(len(owner)) + owner + 1
        token[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        whose = np.full(n, -1, np.int32)
        whose[inside] = owner
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self._rank(token[:-1], token[1:])
        queue = self.queue
        queue.push(rank[inside], inside)
        while queue.top:
            low, places = queue.pop()
            places = at = places[rank[places] == low]  # the others are stale: a merge beside them came first
            if not len(at):
                continue
            at = np.unique(at)
            # Of places that overlap, every second one goes. They are merged from left to right up to where a merge brings
            # up a lower rank, which comes before the rest of its pre-token.
            nth = np.arange(len(at))
            overlaps = np.concatenate([[False], at[1:] == after[at[:-1]]])
            at = at[(nth - np.maximum.accumulate(np.where(overlaps, 0, nth))) % 2 == 0]
            gone = after[at]
            beside = np.concatenate([[False], before[at[1:]] == gone[:-1]])  # right after the merge before
            sides = [self._rank(np.where(beside, low, token[before[at]]), np.full(len(at), low)),
                     self._rank(np.full(len(at), low), token[after[gone]])]
            lower = np.any([(side >= 0) & (side < low) for side in sides], axis=0)
            if lower.any():
                of, upto = whose[at], np.cumsum(lower) - lower
                begins = np.concatenate([[True], of[1:] != of[:-1]])
                now = upto == upto[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
                if not now.all():
                    queue.put(low, places[np.isin(whose[places], of[~now])])  # (those merged now are stale by then)
                    at, gone = at[now], gone[now]
            stop = after[gone]
            token[at], token[gone] = low, -1
            after[at], before[stop] = stop, at
            rank[gone] = -1
            place = np.concatenate([before[at], at])
            rank[place] = new = self._rank(token[place], token[after[place]])
            queue.push(new, place)
        ids = token[token >= 0].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(whose[token >= 0], minlength=len(pieces))) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.pieces.encode([t or "" for t in texts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_READY: dict = {}  # of this Python worker: vocabularies by their broadcast, with what they remember


def _forget() -> None:
    """The worker goes on to other stages, which need its memory."""
    for codec in _READY.values():
        codec.pieces.words.clear()
        codec.pieces.bare.clear()


def _codec(shared, pattern: str) -> ByteBpe:
    key = (shared._path if hasattr(shared, "_path") else id(shared), pattern)
    if key not in _READY:
        _READY.clear()
        _READY[key] = ByteBpe(shared.value, pattern)
    return _READY[key]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
                     decode: bool = True) -> DataFrame:
    """One row per row of `docs`: its `key` column, `ids` (little-endian unsigned 32-bit) and, if asked, `decoded`: the
    bytes the ids stand for. No shuffle. `ranks` is a rank file's path on the driver; the vocabulary (a file of fixed
    size) is broadcast. Other columns of `docs` play no part, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        codec = _codec(shared, pattern)
        ids = codec.encode(batch.column(1).to_pylist())
        return [batch.column(0), ids, *([[codec.decode(i) for i in ids]] if decode else [])]

    return map_slices(docs.select(docs[key].alias("key"), docs[text].alias("text")),
                      f"key {kind}, ids binary" + ", decoded binary" * decode, run, ROWS, _forget).withColumnRenamed("key", key)
