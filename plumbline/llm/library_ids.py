"""Ids of whole texts by a file of the tokenizers library, the same as its own encode(add_special_tokens=False).

Where the file splits texts by the plain byte-level pattern, a slice of texts is cut where the pattern always starts a new
match: at each single space or line end between two other characters, and where punctuation follows a letter. The slice's different chunks are found by
Arrow, those not met before are encoded by the library's BPE model and remembered, and the ids of all texts are then put
together by their chunks' numbers. Texts with other white space, or with the string of an added token (`<|endoftext|>`,
which the library takes as that token), are encoded whole by the library, as are all texts of files that split otherwise."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

START = 0xFF  # before a text's first chunk: a byte that UTF-8 has not
MEMO = 600_000  # chunks remembered; beyond it all are forgotten
LONGEST = 64  # bytes of a remembered chunk at most


def _byte_marks() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on, in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain(told: dict) -> bool:
    splits = told.get("pre_tokenizer") or {}
    return (splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
            and told["model"]["type"] == "BPE" and not any(told.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")))


AT_ONCE = 4 << 20  # bytes of text worked on at once
SAFE = re.compile(rb"[A-Za-z] [A-Za-z]")

# what a byte is; those from SPACE on always start a chunk, and what follows those from LINE on does so as well
OTHER, LETTER, PUNCTUATION, ODD_SPACE, SPACE, LINE, TEXT = range(7)
KINDS = np.zeros(256, np.uint8)
KINDS[[b for b in range(128) if chr(b).isalnum()]] = LETTER
KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = PUNCTUATION
KINDS[[9, 11, 12, 13, 28, 29, 30, 31]] = ODD_SPACE
KINDS[[32, 10, START]] = SPACE, LINE, TEXT


def _accented(buffer: np.ndarray) -> np.ndarray:
    """Whether a Latin letter of U+00C0 to U+00FF (two bytes) ends just before each byte but the first."""
    made = np.zeros(max(len(buffer) - 1, 0), bool)
    made[1:] = (buffer[:-2] == 0xC3) & (buffer[1:-1] != 0x97) & (buffer[1:-1] != 0xB7)
    return made


class Encoder:
    """encode(texts): the texts' ids one after another, and how many each has. `written` is the content of the file."""

    def __init__(self, written: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        told = json.loads(written)
        self.library, self.plain, self.marks = Tokenizer.from_str(written), _plain(told), _byte_marks()
        self.added = [t["content"].encode() for t in told.get("added_tokens") or ()]
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}  # chunks' numbers; number 0 is for odd chunks, which have no ids here
        self.pool, self.begins, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            return self._whole(texts)
        parts, owners = [], []
        for i, text in enumerate(texts):
            found = [text] if len(text) <= AT_ONCE or any(t in text for t in self.added) else list(_segments(text))
            parts.extend(found)
            owners.extend([i] * len(found))
        made, sizes, at = [], [], 0
        while at < len(parts):
            upto, size = at, 0
            while upto < len(parts) and (upto == at or size + len(parts[upto]) <= AT_ONCE):
                size += len(parts[upto])
                upto += 1
            ids, counts = self._slice(parts[at:upto])
            made.append(ids)
            sizes.append(counts)
            at = upto
        counts = np.bincount(owners, np.concatenate(sizes), len(texts)).astype(np.int64) if parts else np.zeros(0, np.int64)
        return np.concatenate([*made, np.zeros(0, "<u4")]), counts

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO:
            self._forget()
        buffer = np.frombuffer(b"".join(part for text in texts for part in (b"\xff", text)), np.uint8)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]  # of each text, its START
        kind = KINDS[buffer]
        mark = kind >= SPACE
        cut = mark.copy()
        cut[1:] |= (kind[:-1] >= LINE) | (kind[1:] == PUNCTUATION) & ((kind[:-1] == LETTER) | _accented(buffer))
        odd, inside = kind == ODD_SPACE, mark & (kind < TEXT)
        odd[:-1] |= inside[:-1] & mark[1:]
        odd[-1:] |= inside[-1:]
        at = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(buffer)).astype("<i8")), pa.py_buffer(buffer)])
        found = chunks.dictionary_encode()
        numbers = self._numbers(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)]
        per_chunk = self.sizes[numbers]
        upto = np.cumsum(per_chunk)
        ids = self.pool[np.repeat(self.begins[numbers] - (upto - per_chunk), per_chunk) + np.arange(upto[-1])]
        first_chunk = np.searchsorted(at, first)
        counts = np.add.reduceat(per_chunk, first_chunk)
        whole = (np.add.reduceat(odd, first) > 0) | (np.add.reduceat(numbers == 0, first_chunk) > 0)
        for token in self.added:
            whole |= np.array([token in text for text in texts], bool)
        return self._with_whole(texts, ids, counts, whole) if whole.any() else (ids, counts)

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The chunks' numbers in the pool of ids; chunks not met before get theirs."""
        memo, known, tokens, sizes, long = self.memo, [], [], [], []
        find = memo.get
        for chunk in chunks:
            number = find(chunk)
            if number is None:
                ids = self._chunk(chunk)
                if ids is None:
                    number = 0
                else:
                    number = len(self.sizes) + len(sizes)
                    tokens.extend(ids)
                    sizes.append(len(ids))
                memo[chunk] = number
                if len(chunk) > LONGEST:
                    long.append(chunk)
            known.append(number)
        for chunk in long:
            del memo[chunk]
        if sizes:
            new = np.array(sizes, np.int64)
            self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(new) - new])
            self.sizes = np.concatenate([self.sizes, new])
            self.pool = np.concatenate([self.pool, np.array(tokens, "<u4")])
        return np.array(known, np.int64)

    def _with_whole(self, texts, ids, counts, whole) -> tuple[np.ndarray, np.ndarray]:
        """The ids where those of the texts marked `whole` are the library's own."""
        own, sizes = self._whole([texts[i] for i in np.flatnonzero(whole)])
        theirs = iter(np.split(own, np.cumsum(sizes)[:-1]))
        parts = [next(theirs) if w else part for w, part in zip(whole, np.split(ids, np.cumsum(counts)[:-1]))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.concatenate([*made, np.zeros(0, "<u4")]), np.array([len(m) for m in made], np.int64)

    def _chunk(self, chunk: bytes) -> list[int] | None:
        """The ids of a chunk (a text's start, a line end, or what starts at a space or at a cut); None if it is odd."""
        if chunk == b"\xff" or chunk == b" ":
            return []  # (a space alone stands beside another mark: such texts are encoded whole)
        text, tokenize = chunk.decode("utf-8", "replace"), self.library.model.tokenize
        if text.isascii():
            if chunk[1:].isalpha() and (chunk[0] == 32 or chunk[:1].isalpha()):
                return [t.id for t in tokenize(text.replace(" ", self.marks[32]))]
        elif text[text[0] == " ":].split() != [text[text[0] == " ":]]:
            return None
        matches = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [t.id for match in matches for t in tokenize(match.encode().decode("latin-1").translate(self.marks))]


def _segments(text: bytes) -> Iterator[bytes]:
    """A very long text cut before single spaces between ASCII letters, where a match of the pattern always starts."""
    at = 0
    while len(text) - at > AT_ONCE:
        found = SAFE.search(text, at + AT_ONCE // 2)
        if found is None:
            break
        yield text[at:found.start() + 1]
        at = found.start() + 1
    yield text[at:]


_READY: dict = {}  # of this Python worker: the encoder, by its broadcast


def share(docs: DataFrame, tokenizer: str) -> Broadcast:
    """The content of a tokenizer's file (its path on the driver; a file of fixed size) for all tasks."""
    with open(tokenizer, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encoder(shared: Broadcast) -> Encoder:
    """This worker's encoder. It stays from task to task, with the chunks that it has met."""
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(shared.value)
    return _READY[key]


def texts_of(column: pa.Array) -> list[bytes]:
    """A column of strings as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
