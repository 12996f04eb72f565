"""Phrases whose words stand together more often than chance, from sorted streams of counts.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces, and these at spaces and tabs into words. Every
place of a piece gives one record: the words from there, five at most. Records are put in prefix order, by ranges and so
that a task sees its records sorted; then all records that start with the same phrase follow each other, and one walk over
the stream has the count of every phrase of two to five words as the length of its run, without a table of phrases. Runs
that go on beyond a task's range are added up afterwards, a few a task.

The counts then make two streams. In prefix order, phrases meet their first parts (the left counts) and those one word
longer at the end; in suffix order, their last parts (the right counts) and those one word longer at the start. The streams
are merged in step by Spark's sort-merge joins.

A phrase can occur `least` times only if its words do, so rarer words end a record as a piece's end does. The words are
counted first, and the frequent ones sent to the tasks, where a record is their numbers in two integers. Where they are more
than MOST_WORDS (or more than MOST_BYTES of text), they are not sent, and records are all their words as text: the same
result from longer streams. Blocks of text are sorted and equal
records added up before they are shuffled, so what is repeated often costs a record a block.

Null and empty texts have no words. A null language counts as `und`. Equal rows count each. Very long texts are worked
on in blocks that overlap by four words. Tables without words give no rows. Other columns play no part. The numbers are
exact (decimals of 38 digits)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..plans.ranked import top_per_group
from .frames import cut, map_slices

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences
MOST_WORDS, MOST_BYTES = 1_000_000, 32 << 20  # of the frequent words sent to all tasks
AT_ONCE = 4 << 20  # bytes of text sorted at once
ROWS = 2048  # texts of a slice
BITS = 21  # of a word's number, so that five make two integers (of a block's own words, too: it has fewer than 2^21)
END = b"\xff"  # after each word of a record: greater than any byte of UTF-8, so a phrase's records stand together

_LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
_BREAKS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(_LETTERS[0] + _BREAKS + b"\t", _LETTERS[1] + b"\n" * len(_BREAKS) + b" ")
FOUR_WORDS = re.compile(rb" *(?:[^ \n]+ *){0,4}")


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """Texts as blocks of about AT_ONCE bytes, words in lower case parted by spaces and pieces by line ends; and how many
    words at the end are there only to go on with, since the next block starts with them."""
    held, size = [], 0
    for text in texts:
        text = text.translate(PLAIN)
        while len(text) > AT_ONCE:
            at = text.rfind(b"\n", AT_ONCE // 2, AT_ONCE)
            if at < 0:
                at = text.rfind(b" ", AT_ONCE // 2, AT_ONCE)
            if at < 0:
                at = min((x for x in (text.find(b" ", AT_ONCE), text.find(b"\n", AT_ONCE)) if x >= 0), default=len(text))
            upto = FOUR_WORDS.match(text, at).end()
            yield text[:upto], len(text[at:upto].split())
            text = text[at:]
        held.append(text)
        size += len(text)
        if size > AT_ONCE:
            yield b"\n".join(held), 0
            held, size = [], 0
    if held:
        yield b"\n".join(held), 0


def _words(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's different words in order, every word's number among them, and every word's piece."""
    buffer = np.frombuffer(block, np.uint8)
    line = buffer == 10
    within = ~(line | (buffer == 32))
    edge = np.diff(np.concatenate([[False], within, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[within])])
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers = place[found.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
    return found.dictionary.take(pa.array(order)), numbers, np.cumsum(line)[starts]


def _packed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records of five numbers as two integers, in the same order."""
    return columns[0] << 2 * BITS | columns[1] << BITS | columns[2], columns[3] << BITS | columns[4]


def _records(numbers: np.ndarray, pieces: np.ndarray, named: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different records of a block, packed and in order, and how often each occurs. `named`: by a word's number, that
    in the record (0: it is in none); the last `alone` words start none."""
    own = named[numbers]
    n = len(own) - alone
    columns = [own[:n]]
    for j in range(1, LONGEST):
        after = np.zeros(n, np.int64)
        upto = max(0, min(n, len(own) - j))
        after[:upto] = np.where((pieces[j:j + upto] == pieces[:upto]) & (columns[-1][:upto] > 0), own[j:j + upto], 0)
        columns.append(after)
    some = columns[1] > 0
    high, low = _packed([c[some] for c in columns])
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    return high[at], low[at], np.diff(np.append(at, len(high)))


def _unpacked(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    mask = (1 << BITS) - 1
    return [high >> 2 * BITS, high >> BITS & mask, high & mask, low >> BITS, low & mask]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, int]]:
    """The words of each block of a slice (lang, text): its language, and what _words and _blocks tell."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        texts[lang].append(text)
    for lang, of in texts.items():
        for block, alone in _blocks(of):
            yield lang, *_words(block), alone


def _columns(parts: list[list[pa.Array]], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.concat_arrays([p[i].cast(kind) for p in parts]) if parts else pa.array([], kind) for i, kind in enumerate(kinds)]


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text")).where("text <> ''")


def count_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, f): how often each word occurs in each language."""
    def run(batch: pa.RecordBatch) -> list:
        made = []
        for name, vocabulary, numbers, _, alone in _by_language(batch):
            counts = np.bincount(numbers[:len(numbers) - alone], minlength=len(vocabulary))
            made.append([pa.array([name] * len(vocabulary)), vocabulary, pa.array(counts)])
        return _columns(made, [pa.string(), pa.string(), pa.int64()])

    counted = map_slices(_texts(docs, lang, text), "lang string, word string, f bigint", run, ROWS)
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f")).where("f > 0")


class Lexicon:
    """Words of several languages by number, from 1."""

    def __init__(self, table: pa.Table):
        self.words, self.langs, self.first = [""], [""], {}
        for name in sorted(table["lang"].unique().to_pylist()):
            words = table.filter(pc.equal(table["lang"], name))["word"].combine_chunks()
            words = words.take(pc.sort_indices(words))
            self.first[name] = len(self.words), words.cast(pa.large_binary())
            self.words += words.to_pylist()
            self.langs += [name] * len(words)

    def numbers(self, lang: str, vocabulary: pa.Array) -> np.ndarray:
        """The numbers of a block's different words, 0 for those that are not here."""
        if lang not in self.first:
            return np.zeros(len(vocabulary), np.int64)
        first, words = self.first[lang]
        return pc.fill_null(pc.add(pc.index_in(vocabulary, value_set=words).cast(pa.int64()), first), 0).to_numpy(zero_copy_only=False)


def frequent_words(counts: DataFrame, least: int, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> Broadcast | None:
    """The words that occur `least` times, for all tasks; None if they are more than may be sent."""
    frequent = counts.where(F.col("f") >= least)
    n, size = frequent.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if n > most_words or (size or 0) > most_bytes:
        return None
    return counts.sparkSession.sparkContext.broadcast(Lexicon(frequent.select("lang", "word").toArrow()))


def records(docs: DataFrame, frequent: Broadcast | None, lang: str = "lang", text: str = "text") -> DataFrame:
    """The records of two words and more, and how often (n) each occurs in a block of text: as numbers of the frequent
    words (high, low), or else as text (key): the language and all words with END after each."""
    def numbered(batch: pa.RecordBatch) -> list:
        made = []
        for name, vocabulary, numbers, pieces, alone in _by_language(batch):
            made.append([pa.array(c) for c in _records(numbers, pieces, frequent.value.numbers(name, vocabulary), alone)])
        return _columns(made, [pa.int64()] * 3)

    def written(batch: pa.RecordBatch) -> list:
        made, end = [], [pa.scalar(x, pa.large_binary()) for x in (b"", END)]
        for name, vocabulary, numbers, pieces, alone in _by_language(batch):
            high, low, counts = _records(numbers, pieces, np.arange(1, len(vocabulary) + 1), alone)
            words = [vocabulary.take(pa.array(c - 1, mask=c == 0)) for c in _unpacked(high, low)]
            made.append([pc.binary_join_element_wise(pa.scalar(name.encode(), pa.large_binary()), *words, *end, null_handling="skip"), pa.array(counts)])
        return _columns(made, [pa.binary(), pa.int64()])

    texts = _texts(docs, lang, text)
    if frequent is None:
        return map_slices(texts, "key binary, n bigint", written, ROWS)
    return map_slices(texts, "high bigint, low bigint, n bigint", numbered, ROWS)


class _Walk:
    """A walk over records in order that counts the runs of records with the same first k words."""

    def __init__(self, least: int):
        self.least, self.seen = least, False
        self.open: dict[int, list] = {}  # by k: the run at the end so far: its phrase, its count, whether it is the first

    def over(self, n: np.ndarray, changes: list[np.ndarray], long: list[np.ndarray], phrase) -> list[tuple]:
        """(phrase, count, whether its run may go on beyond this task) of the runs that end here. By k from 2: where the
        first k words are others than those of the record before, and which records have k; phrase(k, record) names them."""
        out: list[tuple] = []
        for k, (changed, has) in enumerate(zip(changes, long), 2):
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            counts, here = np.add.reduceat(n, starts), has[starts]
            was, begins = self.open.get(k), phrase(k, 0) if here[0] else None
            opening = not self.seen
            if was is not None and begins == was[0]:
                counts[0] += was[1]
                opening = was[2]
            elif was is not None:
                self._end(out, was)
            last = len(starts) - 1
            if last:
                self._end(out, [begins, int(counts[0]), opening])
            for run in np.flatnonzero(here[1:-1] & (counts[1:-1] >= self.least)) + 1:
                out.append((phrase(k, starts[run]), int(counts[run]), False))
            self.open[k] = [phrase(k, starts[last]) if here[last] else None, int(counts[last]), opening and not last]
        self.seen = True
        return out

    def _end(self, out: list[tuple], run: list) -> None:
        if run[0] is not None and (run[2] or run[1] >= self.least):
            out.append(tuple(run))

    def rest(self) -> list[tuple]:
        return [(run[0], run[1], True) for run in self.open.values() if run[0] is not None]


def _over_numbers(walk: _Walk, batch: pa.RecordBatch, lexicon: Lexicon) -> list[tuple]:
    high, low, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    columns = _unpacked(high, low)
    apart = columns[0][1:] != columns[0][:-1]
    changes = []
    for column in columns[1:]:
        apart = apart | (column[1:] != column[:-1])
        changes.append(apart)

    def phrase(k: int, row: int) -> tuple:
        of = [int(c[row]) for c in columns[:k]]
        return lexicon.langs[of[0]], *[lexicon.words[i] for i in of]

    return walk.over(n, changes, [c > 0 for c in columns[1:]], phrase)


def _over_texts(walk: _Walk, batch: pa.RecordBatch) -> list[tuple]:
    keys, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(keys.buffers()[1], "<i4")[keys.offset:keys.offset + len(keys) + 1]
    data = keys.buffers()[2]
    stops = np.flatnonzero(np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] == END[0]) + offsets[0]
    tokens = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.concatenate([offsets[:1], stops + 1]).astype("<i4")), data])
    codes = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.searchsorted(stops, offsets[:-1])
    held = np.diff(np.append(first, len(stops)))  # tokens of each record, its language too
    words = np.full((len(n), LONGEST + 1), -1)
    words[np.repeat(np.arange(len(n)), held), np.arange(len(stops)) - np.repeat(first, held)] = codes
    changes = np.logical_or.accumulate(words[1:] != words[:-1], axis=1)
    text = memoryview(data)

    def phrase(k: int, row: int) -> tuple:
        return tuple(w.decode("utf-8", "replace") for w in bytes(text[offsets[row]:stops[first[row] + k]]).split(END))

    return walk.over(n, [changes[:, k] for k in range(2, LONGEST + 1)], [held > k for k in range(2, LONGEST + 1)], phrase)


def _counted(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p, _, _ in found], pa.string()), pa.array([p[1:] for p, _, _ in found], pa.list_(pa.string())),
        pa.array([f for _, f, _ in found], pa.int64()), pa.array([o for _, _, o in found], pa.bool_())], ["lang", "words", "f", "open"])


def count_phrases(found: DataFrame, frequent: Broadcast | None, least: int = LEAST) -> DataFrame:
    """(lang, words, f): the phrases of two words and more that occur `least` times, from the records made with `frequent`."""
    order = ["key"] if frequent is None else ["high", "low"]
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(least)
        for batch in batches:
            if batch.num_rows:
                yield _counted(_over_texts(walk, batch) if frequent is None else _over_numbers(walk, batch, frequent.value))
        yield _counted(walk.rest())

    runs = cut(ordered.mapInArrow(run, "lang string, words array<string>, f bigint, open boolean"))
    inside = runs.where("NOT open").select("lang", "words", "f")
    across = runs.where("open").groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return inside.unionByName(across)


def collocations(docs: DataFrame, least: int = LEAST, first: int = 2000, most_words: int = MOST_WORDS,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """The `first` phrases of each language: lang, rank, phrase, a (its count), l and r (those of the two parts of the cut
    that scores lowest, of equal ones the first), n (all words of the language) and score, floor(1000 * a * n / (l * r)).
    Phrases that are always part of a longer one are left out."""
    single = cut(count_words(docs, lang, text))
    all_words = single.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = frequent_words(single, least, most_words)
    phrases = cut(count_phrases(records(docs, frequent, lang, text), frequent, least))
    counts = cut(single.where(F.col("f") >= least).select("lang", F.array("word").alias("words"), "f").unionByName(phrases))

    size = F.size("words")
    parts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), F.slice("words", F.lit(1), k).alias("head"), F.slice("words", k + 1, size - k).alias("tail")))
    cuts = phrases.select("lang", "words", F.col("f").alias("a"), F.inline(parts))
    heads = counts.select("lang", F.col("words").alias("head"), F.col("f").alias("l")).hint("merge")  # in prefix order
    tails = counts.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")).hint("merge")  # in suffix order
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(all_words, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    score = F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"]
    scored = scored.select("lang", "words", "a", "n", F.struct(F.call_function(
        "div", score.cast("decimal(38,0)"), (wide["l"] * wide["r"]).cast("decimal(38,0)")).alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "words").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("cut").alias("cut"))

    longer = [phrases.where(size > 2).select("lang", F.slice("words", F.lit(at), size - 1).alias("words"), F.col("f").alias("within")) for at in (1, 2)]
    within = longer[0].unionByName(longer[1]).groupBy("lang", "words").agg(F.max("within").alias("within"))
    kept = lowest.join(within.hint("merge"), ["lang", "words"], "left").where("within IS NULL OR within < a")
    listed = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = top_per_group(listed, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
