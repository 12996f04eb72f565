"""One query per operator over its whole table, with the digest columns that stand for its result."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.lineage import checkpoint_dir
from . import (byte_bpe, collocations, line_dedup, mixing, neighbours, packing, prefix_trie, private_data, quality_model, quality_rules,
               simhash, token_files, toxicity)
from .labelled import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scored(docs: DataFrame, score, held) -> DataFrame:
    return docs.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op1_quality_model(spark, folder):
    docs = _table(spark, folder, "documents")
    model = quality_model.fit(docs, _table(spark, folder, "labels"), lambda key: ~held_out(key, 4, 2))
    return _scored(docs, quality_model.score_column(model, docs["text"]), held_out(F.col("doc_id"), 4, 2))


@query()
def op8_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"), lambda key: ~held_out(key, 3, 1))
    return _scored(docs, toxicity.score_column(model, docs["text"]), held_out(F.col("doc_id"), 3, 1))


@query()
def op5_byte_bpe(spark, folder):
    found = byte_bpe.encode_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                      public_tokenizers.PATTERN)
    return found.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("""
WITH listed AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS lines
  FROM documents),
found AS (
  SELECT doc_id, words, list_aggregate(list_concat([''], words), 'string_agg', '') AS joined, len(words) AS n, lines FROM listed),
windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 4), ' ') AS five
  FROM (SELECT doc_id, words, unnest(range(1, n - 3)) AS pos FROM found)),
twice AS (
  SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS later
  FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, five) AS times FROM windows) WHERE times > 1),
covered AS (SELECT doc_id, sum(least(coalesce(later - pos, 5), 5)) AS n_repeat FROM twice GROUP BY doc_id),
measured AS (
  SELECT doc_id, n AS n_words, length(joined) AS word_chars,
         length(joined) - length(regexp_replace(joined, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(joined) - length(regexp_replace(joined, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS capitals,
         length(joined) - length(regexp_replace(joined, '[0-9]', '', 'g')) AS digits, len(list_distinct(words)) AS different
  FROM found LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * capitals > word_chars
            OR 3 * digits > word_chars OR 20 * different < n_words) AS kept
FROM measured""")
def op2_quality_rules(spark, folder):
    return quality_rules.judge(_table(spark, folder, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op7_token_files(spark, folder):
    path = posixpath.join(checkpoint_dir(spark), f"tokens-{uuid.uuid4().hex}")
    token_files.write_token_files(_table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op9_simhash(spark, folder):
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op10_line_dedup(spark, folder):
    docs = _table(spark, folder, "documents")
    made = line_dedup.drop_repeated_lines(docs)
    return made.select("doc_id", "text")


@query()
def op6_mixing(spark, folder):
    made = mixing.plan(_table(spark, folder, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op4_neighbours(spark, folder):
    return neighbours.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op3_private_data(spark, folder):
    made = private_data.replace(_table(spark, folder, "documents"), b"a key kept with the pipeline's own secrets")
    return made.select("row.doc_id", F.col("clean").alias("text"), *[
        private_data.kind_count(F.col("found"), kind).alias(f"n_{kind}") for kind in private_data.KINDS])


@query("""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM listed),
spans AS (SELECT lang, words, pos, unnest(range(1, least(5, len(words) - pos + 1) + 1)) AS m FROM places),
counts AS (
  SELECT lang, m, array_to_string(list_slice(words, pos, pos + m - 1), ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE m > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.m, c.phrase, a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[:k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT DISTINCT lang, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS pos FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates))),
kept AS (SELECT * FROM lowest o WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = o.lang AND p.phrase = o.phrase AND p.a >= o.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000""")
def op11_collocations(spark, folder):
    return collocations.collocations(_table(spark, folder, "documents"))


@query("""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS num
  FROM conversations WHERE conv_id IS NOT NULL),
original AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY num) AS said FROM numbered GROUP BY conv_id),
-- CRC-32 of the decimal key: each character is xored in, then eight times the register is shifted
keyed AS (
  SELECT conv_id, said, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda s: list_concat([ascii(s)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
         lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END),
         4294967295::BIGINT) % 4 AS h
  FROM original),
rebuilt AS (
  SELECT k.conv_id, list_concat(coalesce(list_slice(s.said, 1, k.h), []), list_slice(k.said, k.h + 1, len(k.said))) AS said
  FROM keyed k LEFT JOIN original s ON s.conv_id = k.conv_id - k.conv_id % 20),
prefixes AS (SELECT conv_id, len(said) AS turns, said, unnest(range(0, len(said) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, turns, list_slice(said, 1, depth) AS path FROM prefixes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(string_split_regex(path[depth].text, '[ \\t-\\r]+'), lambda w: w <> '')) END AS words
  FROM members GROUP BY path, depth),
children AS (SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, depth)),
subtrees AS (
  SELECT list_slice(path, 1, top) AS path, top AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.path = c.path AND s.depth = c.depth
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = list_slice(c.path, 1, c.depth - 1)""")
def op12_prefix_trie(spark, folder):
    conv = F.col("conv")
    turns = prefix_trie.read_turns(_table(spark, folder, "conversations"))
    return prefix_trie.trie(*prefix_trie.share_openings(turns, F.crc32(conv.cast("string")) % 4, conv - conv % 20, 3))


@query()
def op13_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
