"""Toxicity by a counterfactually regularised linear model over sentences.

A sentence's words, their first four letters and pairs of neighbouring words, in lower case without the marks around
them, are hashed into fixed tables of weights; a sentence's sum is its evidence, and a document is as toxic as its most toxic sentence. Learning knows
documents' labels only, so the most toxic sentence of each document is chosen anew in every round.

Counterfactuals: in every sentence learned from that names a group (IDENTITY_TERMS), the term is swapped for others of
its list, and the square of each change of the sentence's evidence is added to the loss. What a swap changes would be the
term alone, so its own weight is driven towards that of the others and groups are not judged by their mention.

The model is fitted on the driver on a bounded sample of labelled rows (PER_CLASS of each class, at most SENTENCES
sentences of each, evenly spread); scoring reads every sentence. A sentence ends with a word that ends in . ! or ?, or
with a line. Null and empty texts have no sentence and get the score of no evidence. Without both classes in the sample
every score is the share of label 1, (ones + 1) / (rows + 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import sample

BUCKETS = 1 << 18
PER_CLASS, SENTENCES, LONGEST = 1500, 120, 400  # rows of a class, sentences of a row, words of a learned sentence
EPOCHS, RATE, SPARSE, FAIR = 60, 0.3, 0.3, 1.0  # SPARSE: documents' worth of evidence that a weight needs
THRESHOLD = 0.7
MEMO = 200_000
STEM = 4  # letters of a word's beginning
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»„“”‘’¿¡…"
#: Terms that name a group, by what kind of group; a term is swapped for those of its own kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "citizens", "refugees", "foreigners"),
    ("americans", "mexicans", "chinese", "russians", "germans", "indians"), ("disabled", "blind", "deaf", "healthy"), ("old", "young", "elderly"),
)


class Words:
    """Numbers of words: 24 bits of the word's hash, 18 of its beginning's (0 for short words), and 1 if it ends a
    sentence. Remembers the words seen, up to MEMO."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > MEMO:
                self.known.clear()
            for at, number in enumerate(found):
                if number is None:
                    word = words[at]
                    found[at] = number = self.number(word)
                    if len(word) <= 64:
                        self.known[word] = number
        return np.array(found, np.int64)

    @staticmethod
    def number(word: str) -> int:
        from xxhash import xxh32_intdigest

        plain = word.lower().strip(MARKS)
        code = lambda part: xxh32_intdigest(part.encode("utf-8", "surrogatepass"))
        start = code(plain[:STEM]) % BUCKETS if len(plain) > STEM else 0
        return (code(plain) & 0xFFFFFF) << 19 | start << 1 | (word[-1] in ".!?")


def _sentences(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of some texts (without the mark of a sentence's end), the place where each sentence starts,
    and the text of each sentence."""
    lines = [(i, line) for i, text in enumerate(texts) if text for line in text.split("\n")]
    split = [line.split() for _, line in lines]
    sizes = np.array([len(s) for s in split], np.int64)
    numbers = words.of([w for s in split for w in s])
    if not len(numbers):
        return numbers, np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat([i for i, _ in lines], sizes)
    first = np.zeros(len(numbers), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first[1:] |= (numbers[:-1] & 1).astype(bool)
    starts = np.flatnonzero(first)
    return numbers >> 1, starts, owner[starts]


def _pairs(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bucket of each word beside the word before it; the first word of a sentence has none (bucket of its own)."""
    hashes = hashes >> 18
    before = np.empty_like(hashes)
    before[1:], before[starts] = hashes[:-1], 0
    return ((hashes * 0x9E3779B1 ^ before * 0x85EBCA77) >> 7) % BUCKETS


def _word(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 18) % BUCKETS


@dataclass
class Model:
    single: np.ndarray  # (BUCKETS,) of words
    stem: np.ndarray  # (BUCKETS,) of their beginnings
    double: np.ndarray  # (BUCKETS,) of pairs
    offset: float

    def evidence(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return np.add.reduceat(self.single[_word(hashes)] + self.stem[hashes % BUCKETS] + self.double[_pairs(hashes, starts)], starts)

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        hashes, starts, owner = _sentences(texts, words)
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, owner, self.evidence(hashes, starts))
        return _sigmoid(np.where(np.isfinite(most), most, 0.0) + self.offset)


@dataclass
class Constant:
    score: float

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        return np.full(len(texts), self.score)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _swaps(hashes: np.ndarray, starts: np.ndarray, terms) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every identity term met, beside the next term of its kind, as buckets of the words, of their beginnings, and of the
    pairs they are part of. The kinds are rings, so all terms of a kind are held to each other."""
    other = {Words.number(a) >> 19: Words.number(kind[(i + 1) % len(kind)]) >> 1 for kind in terms for i, a in enumerate(kind)}
    at = np.flatnonzero(np.isin(hashes >> 18, np.array(list(other), np.int64)))
    swapped = hashes.copy()
    swapped[at] = [other[h] for h in (hashes[at] >> 18).tolist()]
    pairs, pairs_swapped = _pairs(hashes, starts), _pairs(swapped, starts)
    inner = np.setdiff1d(at + 1, starts)
    touched = np.unique(np.concatenate([at, inner[inner < len(hashes)]]))
    return [(_word(hashes[at]), _word(swapped[at])), (hashes[at] % BUCKETS, swapped[at] % BUCKETS), (pairs[touched], pairs_swapped[touched])]


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], terms=IDENTITY_TERMS, fair: float = FAIR) -> Model | Constant:
    """Documents are (hashes, starts of sentences). Full-batch proximal steps: small weights fall to exactly 0."""
    wanted = np.array(labels)
    ones = int(wanted.sum())
    if not 0 < ones < len(wanted):
        return Constant((ones + 1) / (len(wanted) + 2))
    filled = [(h, s) if len(s) else (np.array([0]), np.array([0])) for h, s in documents]
    hashes = np.concatenate([h for h, _ in filled])
    sizes = np.array([len(h) for h, _ in filled])
    starts = np.concatenate([s + base for (_, s), base in zip(filled, np.cumsum(sizes) - sizes)])
    counts = np.array([len(s) for _, s in filled])
    first = np.cumsum(counts) - counts  # the first sentence of each document
    word, stem, pair = _word(hashes), hashes % BUCKETS, _pairs(hashes, starts)
    sentence = np.repeat(np.arange(len(starts)), np.diff([*starts, len(hashes)]))
    document = np.repeat(np.arange(len(counts)), counts)
    weight = np.where(wanted == 1, len(wanted) / (2 * ones), len(wanted) / (2 * (len(wanted) - ones)))

    def evidence_of(buckets: np.ndarray) -> np.ndarray:
        """Log-odds of a bucket's presence in documents of class 1, where more than chance tells them apart."""
        seen = np.unique(document[sentence] * np.int64(BUCKETS) + buckets)
        of, bucket = seen // BUCKETS, seen % BUCKETS
        yes, no = (np.bincount(bucket, wanted[of] == c, BUCKETS) for c in (1, 0))
        odds = np.log((yes + 0.5) / (ones + 1)) - np.log((no + 0.5) / (len(wanted) - ones + 1))
        spread = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
        return np.where(np.abs(odds) > 3 * spread, odds, 0.0)

    # (a start: evidence for, not against)
    model = Model(np.maximum(evidence_of(word), 0) * 0.5, np.maximum(evidence_of(stem), 0) * 0.25, np.zeros(BUCKETS), -1.0)
    swaps = _swaps(hashes, starts, terms)
    squares = [np.full(BUCKETS, 1e-6) for _ in range(3)] + [1e-6]  # of the slopes so far: steps get smaller by bucket
    for _ in range(EPOCHS):
        found = model.evidence(hashes, starts)
        top = np.maximum.reduceat(found, first)
        is_top = found == top[document]
        chosen = np.flatnonzero(is_top & (np.cumsum(is_top) == (np.cumsum(is_top) - is_top)[first][document] + 1))
        off = (_sigmoid(top + model.offset) - wanted) * weight
        slope = np.zeros(len(starts))
        slope[chosen] = off
        step = slope[sentence]
        for k, (table, buckets) in enumerate(((model.single, word), (model.stem, stem), (model.double, pair))):
            slopes = np.bincount(buckets, step, BUCKETS)
            squares[k] += slopes * slopes
            rates = RATE / np.sqrt(squares[k] + 1)
            table[:] = _shrink(table - rates * slopes, rates * SPARSE)
        squares[3] += off.sum() ** 2
        model.offset -= RATE * off.sum() / np.sqrt(squares[3])
        for table, (a, b) in zip((model.single, model.stem, model.double), swaps):
            if len(a):  # the penalty's step, kept stable: a term moves at most onto the other
                change, share = table[a] - table[b], min(0.45, RATE * fair)
                moved = np.bincount(a, change, BUCKETS) / np.maximum(1, np.bincount(a, minlength=BUCKETS))
                back = np.bincount(b, change, BUCKETS) / np.maximum(1, np.bincount(b, minlength=BUCKETS))
                table -= share * moved - share * back
    return model


def _shrink(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "doc_id", text: str = "text",
        per_class: int = PER_CLASS, terms=IDENTITY_TERMS) -> Model | Constant:
    """The model learned from the labelled rows that `learn` (a condition of the key) allows."""
    @F.arrow_udf("struct<hashes: binary, starts: binary>")
    def some_sentences(texts: pa.Array) -> pa.Array:
        rows, words = [], Words()
        for text in texts:
            hashes, starts, _ = _sentences([text.as_py()], words)
            parts = np.split(hashes, starts[1:]) if len(starts) else []
            if len(parts) > SENTENCES:
                parts = [parts[i] for i in np.linspace(0, len(parts) - 1, SENTENCES).astype(int)]
            parts = [p[:LONGEST] for p in parts]
            sizes = np.array([len(p) for p in parts], np.int64)
            rows.append({"hashes": np.concatenate([*parts, np.zeros(0, np.int64)]).astype("<i8").tobytes(), "starts": (np.cumsum(sizes) - sizes).astype("<i8").tobytes()})
        return pa.array(rows, pa.struct([("hashes", pa.binary()), ("starts", pa.binary())]))

    rows = sample(docs, labels, label, learn, per_class, some_sentences(docs[text]), key)
    return train([(np.frombuffer(f.hashes, "<i8"), np.frombuffer(f.starts, "<i8")) for f, _ in rows], [y for _, y in rows], terms)


def score_column(model: Model | Constant, text: Column) -> Column:
    """The probability of label 1 for a text (0 to 1)."""
    shared = _sparse(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own, words = _ready(shared)
        found = [own.scores(texts.slice(at, 256).to_pylist(), words) for at in range(0, len(texts), 256)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(text)


def _sparse(model: Model | Constant):
    """The model as it is sent to tasks: the weights that are not 0."""
    if isinstance(model, Constant):
        return model
    return [(np.flatnonzero(t).astype(np.int32), t[np.flatnonzero(t)]) for t in (model.single, model.stem, model.double)], model.offset


_READY: dict = {}  # of this Python worker: the last model unpacked, and the words seen


def _ready(shared) -> tuple[Model | Constant, Words]:
    words = _READY.setdefault("words", Words())
    if isinstance(shared, Constant):
        return shared, words
    tables = []
    for places, values in shared[0]:
        table = np.zeros(BUCKETS)
        table[places] = values
        tables.append(table)
    return Model(*tables, shared[1]), words


def drop_toxic(docs: DataFrame, model: Model | Constant, text: str = "text", most: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with a score under `most`, with their columns as they were."""
    return docs.where(score_column(model, docs[text]) < most)
