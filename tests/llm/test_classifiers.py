"""Both classifiers: held-out accuracy, slopes, counterfactuals, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_model, toxicity
from plumbline.llm.labelled import held_out, sample
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "k long").select("k", held_out(F.col("k"), 4, 2).alias("h")).collect()
    assert all(r.h == (r.k is not None and zlib.crc32(str(r.k).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("name, label, parts, least", [("op1_quality_model", "quality", 4, 0.97), ("op8_toxicity", "toxic", 3, 0.9)])
def test_held_out_accuracy(spark, name, label, parts, least):
    made = QUERIES[name](spark, FOLDER)
    assert made.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert made.count() == docs.count()
    rows = made.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    clean = [r.predicted for r in rows if r[label] == (1 if label == "quality" else 0)]
    assert np.mean([p == (1 if label == "quality" else 0) for p in clean]) >= 0.97


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(90)] + [(None, "y"), (3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, 1), (6, None)], "doc_id long, quality int")
    rows = sample(docs, labels, "quality", lambda k: k % 3 == 0, 10, F.col("text"))
    assert len(rows) <= 20 and {y for _, y in rows} == {0, 1}


def test_network_slopes():
    random = np.random.default_rng(3)
    documents = [random.integers(0, 256, (n, 2, quality_model.CHUNK), np.uint8) for n in (1, 3, 2)]
    for d in documents:
        d[:, 1] &= 1
    wanted, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    net = quality_model.train(documents, [1, 0, 1], 1)

    def loss():
        pooled = net.pooled(np.concatenate(documents))
        mean = np.array([p.mean(axis=0) for p in np.split(pooled, [1, 4])])
        top = np.array([p.max(axis=0) for p in np.split(pooled, [1, 4])])
        p = quality_model._sigmoid(mean @ net.mean + top @ net.top + net.offset[0])
        return float((-(wanted * np.log(p) + (1 - wanted) * np.log(1 - p)) * weight).mean())

    for part in (net.table, net.filters, net.offsets, net.mean, net.top, net.offset):
        part[...] = random.normal(0, 0.2, part.shape)
    slopes = quality_model._slopes(net, documents, wanted, weight)
    parts = [net.table, net.filters, net.offsets, net.mean, net.top, net.offset]
    for k, part in enumerate(parts):
        flat, at = part.reshape(-1), int(np.abs(slopes[k]).argmax())
        kept = flat[at]
        flat[at] = kept + 2e-3
        high = loss()
        flat[at] = kept - 2e-3
        low = loss()
        flat[at] = kept
        assert abs((high - low) / 4e-3 - slopes[k].reshape(-1)[at]) < 0.05 * abs(slopes[k].reshape(-1)[at]) + 2e-3


def test_chunks_cover_the_whole_text():
    text = "".join(chr(97 + i % 26) for i in range(5000)) + " tail"
    chunks = quality_model.chunks_of(text)
    assert b"tail" in chunks[-1, 0].tobytes() and len(chunks) == 12
    again = np.concatenate([chunks[0, 0], *[c[0][quality_model.CHUNK - quality_model.STEP :] for c in chunks[1:]]])
    assert again[: len(text)].tobytes().decode() == text
    marks = quality_model.chunks_of("the the cat cat cat\n\tsat")[0]
    assert marks[1, :20].tolist() == [0] * 4 + [1] * 4 + [0] * 4 + [1] * 8
    assert quality_model.chunks_of(None).shape == (1, 2, quality_model.CHUNK) and len(quality_model.chunks_of("x " * 9000, 5)) == 5


def test_long_documents_count_whole(spark):
    """Junk anywhere in a long text is seen."""
    model = toxicity.train([toxicity._sentences([t], toxicity.Words())[:2] for t in ["you are an idiot. fine", "all is well here. good"] * 30], [1, 0] * 30)
    assert isinstance(model, toxicity.Model)
    rows = [(1, "all is well here. " * 20000 + "you are an idiot."), (2, "all is well here. " * 20000), (None, None), (4, ""), (5, " \n. ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    found = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_column(model, docs["text"]).alias("s")).collect()}
    assert found[1] > 0.7 > found[2] and found[None] == found[4] < 0.7
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "None"]


def test_groups_are_not_judged_by_their_mention():
    """Toxic sentences name one group more often; without the penalty its neutral mention scores higher."""
    toxic = ["the muslims are idiots.", "those muslims are awful scum.", "idiots they are, all.", "these muslims again, what scum."] * 12
    clean = ["the christians met today.", "a nice day in town.", "the jews of the town met.", "we saw hindus pray."] * 12
    documents = [toxicity._sentences([t], toxicity.Words())[:2] for t in toxic + clean]
    labels = [1] * len(toxic) + [0] * len(clean)
    gap = []
    for fair in (0.0, 1.0):
        model = toxicity.train(documents, labels, fair=fair)
        a, b, bad = model.scores(["the muslims met.", "the christians met.", "what idiots."], toxicity.Words())
        gap.append(a - b)
    assert bad > max(a, b)
    assert abs(gap[1]) < 0.3 * gap[0]


def test_one_class_or_no_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    for module in (quality_model, toxicity):
        model = module.fit(docs, labels, lambda k: F.lit(True))
        wanted = 0.75 if module is quality_model else 0.25
        assert [r[0] for r in docs.select(module.score_column(model, docs["text"])).collect()] == [wanted] * 2
        empty = module.fit(docs.limit(0), labels.limit(0), lambda k: F.lit(True))
        assert empty.score == 0.5 and docs.limit(0).select(module.score_column(empty, docs["text"])).count() == 0
    assert quality_model.keep_good(docs, quality_model.Constant(0.9)).columns == docs.columns
