"""The pipeline, stage by stage, against plain versions of each stage on its own input."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_simhash import plain_groups, plain_print

import corpus_pipeline
from plumbline.llm import quality_model
from plumbline.llm.byte_bpe import read_ranks
from plumbline.llm.labelled import held_out
from plumbline.llm.line_dedup import normal_lines
from plumbline.llm.mixing import targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        made.append(docs)
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(sorted(s.dtypes) == sorted(stages[0].dtypes) for s in stages[1:-1])
    assert all(s.count() for s in stages)


def test_quality(spark, stages):
    model = quality_model.fit(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), lambda key: ~held_out(key, 4, 2))
    given = stages[0].collect()
    score = dict(zip([r.doc_id for r in given], model.scores([r.text for r in given])))
    kept = rows(stages[1])
    assert all((r.doc_id in kept) == (score[r.doc_id] >= 0.7) for r in given if abs(score[r.doc_id] - 0.7) > 1e-4)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(held_out(F.col("doc_id"), 4, 2)).collect()
    given_ids = {r.doc_id for r in given}
    assert np.mean([(r.doc_id in kept) == r.quality for r in labels if r.doc_id in given_ids]) > 0.9


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert before.keys() == after.keys()
    stays = plain_lines([(k, r.text) for k, r in before.items()])
    group = {place[1::2]: i for i, places in enumerate(stays.values()) for place in [(p[0], p[1], None, p[3]) for p in places]}
    left = Counter()
    for k, r in after.items():
        old, new = before[k].text.split("\n"), r.text.split("\n") if r.text else []
        normal = normal_lines(before[k].text)
        at = iter(enumerate(old))
        for line in new:
            i = next(i for i, x in at if x == line)
            if normal[i]:
                left[group[k, i]] += 1
        assert r.n_chars == len(r.text)
    assert set(left.values()) == {1} and len(left) == len(stays)


def test_documents(stages):
    before, after = stages[2].collect(), stages[3].collect()
    groups = plain_groups([plain_print(r.text) for r in before])
    least = {}
    for r, g in zip(before, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_mix(stages):
    before, after = rows(stages[3]), Counter(r.doc_id for r in stages[4].collect())
    size = {k: len(r.text.split()) for k, r in before.items()}
    assert set(after) <= set(before) and max(after.values()) <= 2
    sources = sorted({r.source for r in before.values()})
    total = [sum(size[k] for k, r in before.items() if r.source == s) for s in sources]
    wanted = targets(total, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(total), 2)
    for s, w in zip(sources, wanted):
        taken = sum(n * size[k] for k, n in after.items() if before[k].source == s)
        assert abs(taken - w) <= max(size[k] for k, r in before.items() if r.source == s)


def test_ids(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    wanted = sorted((r.doc_id, np.array(library.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in stages[5].collect()) == wanted


def test_run(spark, stages):
    made = corpus_pipeline.run(spark, FOLDER)
    assert sorted(made.columns) == sorted(stages[5].columns)
    assert sorted(r.doc_id for r in made.collect()) == sorted(r.doc_id for r in stages[5].collect())
