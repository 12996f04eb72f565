"""Packing against a plain version of its rule, and its pieces against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import QUADRATIC, assign, pack, rooms

FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain(sizes, length, quadratic):
    """The rule, with lists."""
    left, cost, used, made = rooms(sum(sizes), length), {}, Counter(), []

    def put(doc, first, ids, to):
        made.append((doc, first, ids, to, used[to]))
        used[to] += ids
        left[to] -= ids
        cost[to] = cost.get(to, 0) + ids + quadratic * ids * ids

    order = sorted((d for d in range(len(sizes)) if sizes[d]), key=lambda d: (-sizes[d], d))
    for doc in list(order):
        fitting = [s for s in range(len(left)) if left[s] >= sizes[doc]]
        if fitting:
            put(doc, 0, sizes[doc], min(fitting, key=lambda s: (cost.get(s, 0), s)))
            order.remove(doc)
    for doc in order:
        first = 0
        while first < sizes[doc]:
            to = max(range(len(left)), key=lambda s: (left[s], -s))
            ids = min(sizes[doc] - first, left[to])
            put(doc, first, ids, to)
            first += ids
    return made


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=40))
def test_the_rule(sizes):
    assert assign(np.array(sizes, np.int64), 16, 1 / 16) == plain(sizes, 16, 1 / 16)


def test_rooms():
    assert rooms(0, 1024) == [] and rooms(1024, 1024) == [1024] and rooms(2048 + 1000, 1024) == [1024, 1024, 512, 256, 128, 64, 32, 8]
    assert all(sum(rooms(n, 100)) == n for n in range(500))


def test_costs_and_cuts():
    """Documents of up to half a sequence: costs are nearer each other than where they follow one another, and few are cut."""
    sizes = np.random.default_rng(3).integers(1, 512, 4096)
    made, cost, pieces = assign(sizes, 1024), Counter(), Counter()
    for doc, _, ids, to, _ in made:
        cost[to] += ids + QUADRATIC * ids * ids
        pieces[doc] += 1
    naive, cuts, upto = Counter(), 0, 0
    for size in sizes:
        cuts += upto // 1024 != (upto + size - 1) // 1024
        while size:
            ids = min(size, 1024 - upto % 1024)
            naive[upto // 1024] += ids + QUADRATIC * ids * ids
            upto, size = upto + ids, size - ids
    full = sum(sizes) // 1024
    assert np.std([cost[s] for s in range(full)]) < 0.8 * np.std([naive[s] for s in range(full)])
    assert sum(n > 1 for n in pieces.values()) < 0.1 * cuts


def check(rows, texts, length):
    """Every id of every document in one piece, sequences without gaps, and no padding but at powers of two."""
    library = Tokenizer.from_file(FILE)
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert documents.keys() == {k for k, _ in texts}
    wanted = defaultdict(Counter)
    for k, t in texts:
        wanted[k][tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    for k, pieces in documents.items():
        if sum(wanted[k].values()) == 1:
            ids = np.array(next(iter(wanted[k])), "<u4")
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
                at += p.length
                assert p.ids_crc32 == zlib.crc32(ids[p.start:at])
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(len(i) * n for i, n in wanted[k].items())
            assert {p.doc_tokens for p in pieces} == {len(i) for i in wanted[k]}
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or at < length and at & (at - 1) == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_documents(spark, block):
    texts = [(i, f"Some words of document {i}. " * (i * i % 97)) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "x <|endoftext|> y"), (203, "long " * 20_000), (None, "no key"), (204, "twice"), (204, "twice"), (204, "another text")]
    docs = spark.createDataFrame([(*t, 1, "x", 2) for t in texts], "doc_id long, text string, start int, place string, block int").repartition(3)
    check(pack(docs, FILE, block=block).collect(), texts, 1024)
    short = pack(docs, FILE, length=16, block=block)
    check(short.collect(), texts, 16)
    assert sorted(map(str, short.collect())) == sorted(map(str, short.collect()))


def test_one_key_for_many_rows(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'the same text' as text")
    rows = pack(docs, FILE, length=64, block=100).collect()
    blocks = Counter(r.sequence_id >> 32 for r in rows)
    assert len(blocks) == 30 and max(blocks.values()) < 400


def test_no_documents(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
