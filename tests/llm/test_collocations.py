"""Collocations against plain counting in Python."""

import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, key string, n int, words string"


def plain(docs, least, first=2000):
    counts, out = {}, []
    for text, lang in docs:
        of = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for m in range(1, 6):
                of.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    for lang, of in counts.items():
        n = sum(f for p, f in of.items() if len(p) == 1)
        rows = []
        inside = {p[i:j] for p, f in of.items() if f >= least for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and of[p[i:j]] <= f}
        for p, a in of.items():
            if len(p) > 1 and a >= least and p not in inside:
                score, _, k = min((1000 * a * n // (of[p[:k]] * of[p[k:]]), k, k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, rank, r[2].decode(), -r[1], r[3], r[4], n, -r[0]) for rank, r in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def found(spark, docs, least, parts=3, **more):
    table = spark.createDataFrame([(i, t, lang, "k", 1, "w") for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in C.collocations(table, least=least, **more).collect())


def made(n):
    state, docs = 11, []
    for i in range(n):
        words = []
        for _ in range(30):
            state = state * 1103515245 + 12345 & 0x7FFFFFFF
            words.append(("the", "of", "New", "york", "état", "x\x01", "b", "bb", "city", "Ö", "a—b", "it's")[state // 99 % 12])
            words.append((" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ", " ")[state // 9999 % 10])
        docs.append(("".join(words), ("en", "de", None)[i % 3]))
    return docs


ODD = [(None, "en"), ("", "en"), (" \n. ", "en"), ("one", "fr"), ("same words here", "en"), ("same words here", "en"), ("New York City", None), ("new york city", "und")]


@pytest.mark.parametrize("least", [2, 5])
def test_texts(spark, least):
    docs = made(60) + ODD
    wanted = plain(docs, least)
    assert len(wanted) > 50
    assert found(spark, docs, least) == wanted
    assert found(spark, docs, least, most_words=3) == wanted  # words not sent to the tasks
    assert found(spark, docs, least, first=7) == plain(docs, least, 7)


def test_streams_cut_anywhere(spark):
    """Small batches and many ranges, so that runs go on from one to the next."""
    docs, size = made(40) + [("the of the of " * 50, "en")] * 3, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        assert found(spark, docs, 3) == plain(docs, 3)
        assert found(spark, docs, 3, most_words=3) == plain(docs, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def counted(texts):
    words, records = Counter(), Counter()
    for block, alone in C._blocks([t.encode() for t in texts]):
        vocabulary, numbers, pieces = C._words(block)
        names = [w.decode() for w in vocabulary.to_pylist()]
        assert names == sorted(names, key=str.encode)
        words.update(names[i] for i in numbers[:len(numbers) - alone])
        high, low, n = C._records(numbers, pieces, np.arange(1, len(names) + 1), alone)
        for row, times in zip(zip(*C._unpacked(high, low)), n):
            records[tuple(names[i - 1] for i in row if i)] += int(times)
    return words, records


def test_long_texts_in_blocks(monkeypatch):
    texts = [" ".join(f"w{i % 7}" for i in range(400)), "a\n" * 90 + "b c d e f g h " * 40, "x" * 300 + " y z " + "q" * 200, "tail of it"]
    whole = counted(texts)
    for size in (1 << 20, 100, 40, 11):
        monkeypatch.setattr(C, "AT_ONCE", size)
        assert counted(texts) == whole


def test_nothing(spark):
    assert found(spark, [], 2) == [] and found(spark, [(None, "en"), ("", None)], 2) == [] and found(spark, [("one two", "en")], 2) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^12, as from a far larger table."""
    def many(docs, *_):
        return spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 3 * 10**12), ("en", "c", 10**15)], "lang string, word string, f bigint")

    monkeypatch.setattr(C, "count_words", many)
    monkeypatch.setattr(C, "records", lambda *_: spark.createDataFrame([(1 << 42 | 2 << 21, 0, 2 * 10**12)], "high bigint, low bigint, n bigint"))
    docs = spark.createDataFrame([("x", "en")], "text string, lang string")
    n = 10**15 + 7 * 10**12
    assert [tuple(r) for r in C.collocations(docs).collect()] == [("en", 1, "a b", 2 * 10**12, 4 * 10**12, 3 * 10**12, n, 1000 * 2 * 10**12 * n // (12 * 10**24))]
