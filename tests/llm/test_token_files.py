"""Token files against the tokenizers library, read back from the files."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_byte_bpe import ODD
from tokenizers import Tokenizer

from plumbline.llm import library_ids
from plumbline.llm.library_ids import Encoder
from plumbline.llm.token_files import token_checksums, token_index, write_token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def encoded(own, texts):
    ids, counts = own.encode([(t or "").encode("utf-8", "replace") for t in texts])
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


MORE = ["x <|endoftext|> y", "<|endoftext|>", "", " lead", "trail ", "\n", "x\n", "\nx", "a  b", "a\n\nb", "tab\tx", "a,b.c!? é, ü. ×, ÷. d×,", "it's we'll", "x’s",
        "12,5 a-b", "Ünï,ö.", "—, x", "a ,b", "q\u00a0r s", "\u2003a", "a\x85b", "\x1cq w", "x,\n,y"]


def test_texts(library):
    own, texts = Encoder(open(FILE, encoding="utf-8").read()), [*ODD, *MORE]
    assert own.plain
    for _ in range(2):
        assert encoded(own, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_very_long_text(library):
    own, text = Encoder(open(FILE, encoding="utf-8").read()), ("Some words, é. " * 700_000).strip()
    assert encoded(own, ["a", text, "b"])[1] == library.encode(text, add_special_tokens=False).ids
    assert encoded(own, [" x" * 3_000_000]) == [library.encode(" x" * 3_000_000, add_special_tokens=False).ids]


def test_more_chunks_than_remembered(library, monkeypatch):
    monkeypatch.setattr(library_ids, "MEMO", 5)
    own = Encoder(open(FILE, encoding="utf-8").read())
    for n in range(4):
        texts = [f"Words{i} of {n}, {i * n}." for i in range(9)]
        assert encoded(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_with_other_splitting():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Encoder(open(path, encoding="utf-8").read())
    assert not own.plain
    assert encoded(own, ["Some words", "", "more"]) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Some words", "", "more")]


def test_files(spark, library, tmp_path):
    texts = [None, *ODD, ODD[3], ODD[3], MORE[0]]
    rows = [(7 * i % 31 if i % 9 else i % 2 or None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    path = f"file://{tmp_path}/tokens"
    write_token_files(docs, path, FILE)
    found = token_checksums(spark, path).orderBy("start").collect()
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and None in keys
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    ids = {(k, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t, _, _ in rows}
    assert sorted((r.n_tokens, r.ids_crc32) for r in found) == sorted((len(ids[k, t]), zlib.crc32(ids[k, t])) for k, t, _, _ in rows)
    assert sorted(map(tuple, token_index(spark, path).select("start", "n_tokens").collect())) == [(r.start, r.n_tokens) for r in found]


def test_how_files_are_laid_out(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Word {i} of a text. " * 30) for i in range(3000)], "doc_id long, text string").repartition(2)
    write_token_files(docs, f"file://{tmp_path}/tokens", FILE)
    for file in sorted((tmp_path / "tokens").glob("part-*.parquet")):
        group = pq.ParquetFile(file).metadata.row_group(0)
        kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in kinds["ids.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings
        assert all(column.has_column_index and column.has_offset_index for column in kinds.values())


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, f"file://{tmp_path}/none", FILE)
    assert token_checksums(spark, f"file://{tmp_path}/none").count() == 0
