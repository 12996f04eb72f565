"""Mixing: targets, the splitting tree, and what is taken."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from plumbline.llm.mixing import mixed, plan, split_tree, targets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert abs(sum(found) - 1.5 * sum(sizes)) <= 1e-6 * max(1, sum(sizes))
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
    free = [t / w for t, w, s in zip(found, weights, sizes) if t < 2 * s * (1 - 1e-9)]
    assert not free or max(free) - min(free) <= 1e-6 * max(free)
    # a source that stopped would have got more
    assert all(not free or 2 * s / w <= max(free) * (1 + 1e-9) for t, w, s in zip(found, weights, sizes) if t >= 2 * s * (1 - 1e-9))


def test_tree():
    draws = [1000, 0, 37, 2500, 1]
    made = split_tree(draws, 16, 3)
    assert made.sum(axis=0).tolist() == draws and (made >= 0).all()
    assert made.sum(axis=1).max() - made.sum(axis=1).min() <= 1
    assert (made == split_tree(draws, 16, 3)).all() and not (made == split_tree(draws, 16, 4)).all()
    many = np.array([split_tree([600, 400], 4, s)[0, 0] for s in range(3000)])  # 250 draws of 1,000
    assert abs(many.mean() - 150) < 1 and abs(many.std() - (250 * 0.6 * 0.4 * 750 / 999) ** 0.5) < 0.5


def documents(n=3000):
    pick = random.Random(2)
    sources = ["b", "a", "é", "z", None, "Z", "big"]
    rows = []
    for i in range(n):
        source = "big" if pick.random() < 0.5 else pick.choice(sources)
        rows.append((i, " ".join("w" * pick.randrange(1, 4) for _ in range(pick.choice([3, 20, 100]))), source))
    rows += [(n, "x " * 4000, "a"), (n + 1, None, "a"), (None, "no key", None), (n + 2, "", "b"), rows[0], rows[0], (n + 3, None, "empty")]
    return rows


def test_plan(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as target")
    found = plan(docs).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").split())
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(k), size(t)) for k, t, _ in rows)
    sizes, taken, longest = Counter(), Counter(), defaultdict(int)
    for k, t, s in rows:
        sizes[s] += size(t)
        longest[s] = max(longest[s], size(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    wanted = dict(zip(order, targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6 and 0 <= r.copies <= 2
        assert len(r.shards) == len(r.places) == r.copies and all(0 <= s < 64 for s in r.shards)
        taken[r.source] += r.copies * r.size
    for s in order:
        assert abs(taken[s] - wanted[s]) <= max(longest[s], 1), (s, taken[s], wanted[s])
    again = plan(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    shards = Counter(s for r in found for s in r.shards)
    assert len(shards) == 64


def test_mix(spark):
    rows = documents(400)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, row string")
    copies = Counter({})
    for r in plan(docs).collect():
        copies[str(r.doc_id)] += r.copies
    made = mixed(docs)
    assert made.columns == docs.columns
    assert Counter(str(r.doc_id) for r in made.collect()) == +copies


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert plan(docs).count() == 0 and mixed(docs).count() == 0
