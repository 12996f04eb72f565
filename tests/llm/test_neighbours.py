"""Neighbours against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.neighbours import fit, hilbert, search
from plumbline.llm.queries import QUERIES


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (5, 2), (1, 5)])
def test_hilbert_steps_are_of_one_cell(n, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    order = np.argsort(hilbert(cells, bits))
    assert sorted(hilbert(cells, bits).tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def brute(rows, found):
    """rows: {id: vector}; (query, rank, id, score) for ids divisible by 100."""
    ids = np.array(sorted(rows))
    held = np.array([rows[i] for i in ids.tolist()])
    made = []
    for q in ids[ids % 100 == 0].tolist():
        apart = np.sqrt(((held - rows[q]) ** 2).sum(axis=1))
        apart[ids == q] = np.inf
        best = [i for i in np.lexsort((ids, apart))[:found] if np.isfinite(apart[i])]
        made += [(q, k, int(ids[i]), float(apart[i])) for k, i in enumerate(best, 1)]
    return made


def recall(found, wanted):
    have = {(r[0], r[2]) for r in found}
    return np.mean([(w[0], w[2]) in have for w in wanted])


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    made = [tuple(r) for r in QUERIES["op4_neighbours"](spark, folder).collect()]
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    wanted = brute(rows, 10)
    assert len(made) == len(wanted) and recall(made, wanted) >= 0.9
    for q, rank, i, score in made:
        assert i != q and abs(score - np.sqrt(((rows[q] - rows[i]) ** 2).sum())) < 1e-12
    assert {(q, rank) for q, rank, _, _ in made} == {(q, rank) for q, rank, _, _ in wanted}


def test_clusters_get_narrow_windows():
    random = np.random.default_rng(1)
    centres = random.normal(size=(400, 32))
    vectors = (centres[:, None] + 0.01 * random.normal(size=(400, 10, 32))).reshape(-1, 32)
    assert fit(vectors, 5).share <= 0.012


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (300, [0.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    found = sorted(tuple(r) for r in search(table, F.col("vec_id") % 100 == 0).collect())
    wanted = brute({0: np.array([1.0, 0]), 100: np.array([0, 1.0]), 1: np.array([1.0, 1]), 2: np.array([1.0, -1]), 3: np.array([1.0, 1])}, 10)
    assert found == sorted(wanted)
    assert search(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert search(table.where("vec_id = 6"), F.col("vec_id") % 100 == 0).collect() == []


def test_a_vector_that_most_rows_have(spark):
    random = np.random.default_rng(4)
    rows = {i: ([1.0, 2.0, 3.0] if i % 5 else random.normal(size=3).round(1).tolist()) for i in range(4000)}
    rows |= {900: [1.0, 2.0, 3.0], 1700: [1.0, 2.0, 3.0]}
    rows = {i: v if any(v) else [0.1, 0.0, 0.0] for i, v in rows.items()}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = [tuple(r) for r in search(table, F.col("vec_id") % 100 == 0).collect()]
    wanted = brute({i: np.array(v) for i, v in rows.items()}, 10)
    assert len(found) == len(wanted) and recall(found, wanted) >= 0.95
    mine = sorted(r for r in found if r[0] == 900)
    assert [r[2] for r in mine] == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12] and {r[3] for r in mine} == {0.0}
