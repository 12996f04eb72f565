"""Quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 with its white space as single spaces. Each byte is looked up in a learned table of a few
numbers; one more input marks the bytes of a word that is the same as the word before it. Chunks of 512 bytes, each
overlapping the next by 64, cover the whole document. Learned filters run over the chunks, each filter keeps its highest
answer in a chunk, and the mean and the highest of a document's chunks are combined into one probability.

The network is fitted on the driver on a bounded sample of labelled rows (PER_CLASS of each class, at most CHUNKS chunks
of each, evenly spread over it); scoring reads every byte. Null and empty texts are one chunk of padding. Without both
classes in the sample every score is the share of label 1, (ones + 1) / (rows + 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import sample

CHUNK, STEP = 512, 448
WIDTH, STRIDE, SIZE, FILTERS = 8, 4, 8, 24
PER_CLASS, CHUNKS, EPOCHS, BATCH, RATE = 800, 5, 14, 64, 0.01
THRESHOLD = 0.7
BLOCK = 256  # chunks worked on at once


def chunks_of(text: str | None, most: int | None = None) -> np.ndarray:
    """The chunks of a text, (n, 2, CHUNK): bytes, and marks of repeated words; `most` of them, evenly spread, or all."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    joined = b" ".join(words)
    count = max(1, -(-(len(joined) - (CHUNK - STEP)) // STEP))
    held = np.zeros((2, (count - 1) * STEP + CHUNK), np.uint8)
    if words:
        held[0, : len(joined)] = np.frombuffer(joined, np.uint8)
        again = np.fromiter((a == b for a, b in zip(words, [None, *words])), np.uint8, len(words))
        held[1, : len(joined)] = np.repeat(again, [len(w) + 1 for w in words])[:-1]
    made = sliding_window_view(held, CHUNK, axis=1)[:, ::STEP].transpose(1, 0, 2)
    return made if most is None or count <= most else made[np.linspace(0, count - 1, most).astype(int)]


@dataclass
class Network:
    table: np.ndarray  # (256, SIZE)
    filters: np.ndarray  # (WIDTH * (SIZE + 1), FILTERS)
    offsets: np.ndarray  # (FILTERS,)
    mean: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (FILTERS,)
    offset: np.ndarray  # (1,)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """What the filters see: (n, places, WIDTH * (SIZE + 1))."""
        seen = np.empty((len(chunks), CHUNK, SIZE + 1), np.float32)
        seen[..., :SIZE] = self.table[chunks[:, 0]]
        seen[..., SIZE] = chunks[:, 1]
        return sliding_window_view(seen.reshape(len(chunks), -1), WIDTH * (SIZE + 1), axis=1)[:, :: STRIDE * (SIZE + 1)]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's highest answer in each chunk, not below 0."""
        parts = []
        for at in range(0, len(chunks), BLOCK):
            answers = self.windows(chunks[at : at + BLOCK]) @ self.filters
            parts.append(np.maximum(answers.max(axis=1) + self.offsets, 0))
        return np.concatenate(parts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probabilities of texts, whose chunks are worked on together in blocks."""
        made, held, sizes = [], [], []

        def flush() -> None:
            if held:
                pooled = self.pooled(np.concatenate(held))
                starts = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(pooled, starts, axis=0) / np.array(sizes)[:, None]
                made.append(_sigmoid(mean @ self.mean + np.maximum.reduceat(pooled, starts, axis=0) @ self.top + self.offset[0]))
                held.clear()
                sizes.clear()

        for text in texts:
            held.append(chunks_of(text))
            sizes.append(len(held[-1]))
            if sum(sizes) >= BLOCK:
                flush()
        flush()
        return np.concatenate(made) if made else np.zeros(0)


@dataclass
class Constant:
    score: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.score)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def train(documents: list[np.ndarray], labels: list[int], seed: int = 0) -> Network | Constant:
    """Adam on the log loss, both classes with the same total weight."""
    wanted = np.array(labels)
    ones = int(wanted.sum())
    if not 0 < ones < len(wanted):
        return Constant((ones + 1) / (len(wanted) + 2))
    random = np.random.default_rng(seed)
    inputs = WIDTH * (SIZE + 1)
    net = Network(*[x.astype(np.float32) for x in (
        random.normal(0, 0.5, (256, SIZE)), random.normal(0, inputs**-0.5, (inputs, FILTERS)), np.zeros(FILTERS),
        random.normal(0, 0.1, FILTERS), random.normal(0, 0.1, FILTERS), np.zeros(1))])
    weight = np.where(wanted == 1, len(wanted) / (2 * ones), len(wanted) / (2 * (len(wanted) - ones)))
    parts = [net.table, net.filters, net.offsets, net.mean, net.top, net.offset]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    epochs = max(EPOCHS, -(-EPOCHS * 20 * BATCH // max(1, len(wanted))) if len(wanted) < 20 * BATCH else EPOCHS)
    for _ in range(epochs):
        turn = random.permutation(len(wanted))
        for at in range(0, len(turn), BATCH):
            batch = turn[at : at + BATCH]
            slopes = _slopes(net, [documents[i] for i in batch], wanted[batch], weight[batch])
            step += 1
            for part, slope, m, v in zip(parts, slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                part -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * part).astype(np.float32)
    return net


def _slopes(net: Network, documents: list[np.ndarray], wanted: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The loss's slopes in the network's parts; only the place of a filter's highest answer in a chunk passes one on."""
    chunks, sizes = np.concatenate(documents), np.array([len(d) for d in documents])
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    windows = net.windows(chunks)
    answers = windows @ net.filters
    place = answers.argmax(axis=1)
    each, which = np.arange(len(chunks))[:, None], np.arange(FILTERS)
    pooled = np.maximum(answers[each, place, which] + net.offsets, 0)
    mean, top = np.add.reduceat(pooled, starts, axis=0) / sizes[:, None], np.maximum.reduceat(pooled, starts, axis=0)
    off = ((_sigmoid(mean @ net.mean + top @ net.top + net.offset[0]) - wanted) * weight / len(wanted)).astype(np.float32)
    is_top = pooled == top[owner]
    is_top &= np.cumsum(is_top, axis=0) == (np.cumsum(is_top, axis=0) - is_top)[starts][owner] + 1  # the first of equals
    back = off[owner, None] * (net.mean / sizes[owner, None] + net.top * is_top) * (pooled > 0)
    seen = windows[each, place]  # (chunks, FILTERS, inputs)
    onto = (back[..., None] * net.filters.T).reshape(len(chunks), FILTERS, WIDTH, SIZE + 1)[..., :SIZE]
    bytes_seen = sliding_window_view(chunks[:, 0], WIDTH, axis=1)[:, ::STRIDE][each, place]
    table = np.stack([np.bincount(bytes_seen.ravel(), onto[..., k].ravel(), 256) for k in range(SIZE)], axis=1)
    return [table, np.einsum("cf,cfk->kf", back, seen), back.sum(axis=0), (off[:, None] * mean).sum(axis=0), (off[:, None] * top).sum(axis=0), off.sum(keepdims=True)]


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id", text: str = "text",
        per_class: int = PER_CLASS) -> Network | Constant:
    """The network learned from the labelled rows that `learn` (a condition of the key) allows."""
    @F.arrow_udf("binary")
    def some_chunks(texts: pa.Array) -> pa.Array:
        return pa.array([np.ascontiguousarray(chunks_of(t.as_py(), CHUNKS)).tobytes() for t in texts], pa.binary())

    rows = sample(docs, labels, label, learn, per_class, some_chunks(docs[text]), key)
    return train([np.frombuffer(f, np.uint8).reshape(-1, 2, CHUNK) for f, _ in rows], [y for _, y in rows])


def score_column(model: Network | Constant, text: Column) -> Column:
    """The probability of label 1 for a text (0 to 1)."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [model.scores(texts.slice(at, 128).to_pylist()) for at in range(0, len(texts), 128)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(text)


def keep_good(docs: DataFrame, model: Network | Constant, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with a score of at least `least`, with their columns as they were."""
    return docs.where(score_column(model, docs[text]) >= least)
