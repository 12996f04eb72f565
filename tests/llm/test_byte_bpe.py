"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from plumbline.llm.byte_bpe import ByteBpe, encode_documents, read_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's we'll 's  's", "I'M", "ünïcödé ßtraße", "日本語 テスト 123",
       "x" * 5000, " " * 700 + "x", "\t\ttabs nbsp   x y", "é ́", "👩‍👩‍👧 emoji", "<|endoftext|> b", "a\x1cb \x1c c \x85 d",
       "end. Next,*** a### $$$", "Ⅷ ² ½ x²", "ʰa bʰ", "don't’s", "aaaaaaaaaaaaaaaaabababab" * 40, "0123456789" * 30]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(read_ranks(RANKS), public_tokenizers.PATTERN)


def same(own, library, text):
    [ids] = own.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Co", "Cs"]) | st.sampled_from(" \n\t'sab.é"), max_size=60))
def test_any_text(own, library, text):
    same(own, library, text)


def test_a_very_long_pre_token(own, library):
    letters = random.Random(1)
    same(own, library, "".join(letters.choice("etaoinsh") for _ in range(60_000)))


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, "aab" * 2000, "=" * 4097, "\n" * 3000, " " * 2500, "abcabd" * 800, "ha" * 999 + "h", "0" * 777, "éé" * 700])
def test_runs(own, library, text):
    same(own, library, text)
    same(own, library, "x" + text + "yz")


def test_a_million_equal_letters(own):
    started = time.time()
    [ids] = own.encode(["a" * 1_000_000])
    assert own.decode(ids) == b"a" * 1_000_000 and time.time() - started < 20


def test_all_at_once(own, library):
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(ODD * 2)] == [library.encode_ordinary(t) for t in ODD * 2]


def test_a_memo_that_starts_anew(own, library):
    small = ByteBpe(own.ranks, public_tokenizers.PATTERN)
    small.pieces.memo = 5
    for text in ODD:
        same(small, library, text)


def test_documents(spark, library):
    texts = [None, *ODD, ODD[3], ODD[3]]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    wanted = sorted((hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4")).hexdigest(), t or "") for t in texts)
    assert sorted((hashlib.sha256(r.ids).hexdigest(), r.decoded.decode()) for r in found) == wanted
    assert sum(r.doc_id is None for r in found) == 1
    assert encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
