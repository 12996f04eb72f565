"""SimHash near-duplicates against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import components, simhash
from plumbline.llm.components import connected, cut, linked_in_buckets
from plumbline.llm.simhash import bucket_keys, fingerprint, home, keep_one, near_duplicates


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É È é Ab\x85c d", "x " * 10000, "word " * 7 + "end"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_print(text)


def test_every_word_is_within_three_bits_of_its_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20000, dtype=np.int32)
    errors = simhash._errors()
    assert (errors >= 0).all() and len(np.unique(errors)) == 2048
    nearest = words ^ errors[simhash._syndrome(words)]
    assert (simhash._syndrome(nearest) == 0).all()
    assert (np.bitwise_count(words ^ nearest) <= 3).all() and (home(nearest) == home(words)).all()


def test_prints_up_to_three_bits_apart_share_a_bucket():
    pick = random.Random(2)
    for bits in (0, 1, 2, 3):
        a = [pick.getrandbits(64) for _ in range(3000)]
        b = [x ^ sum(1 << i for i in pick.sample(range(64), bits)) for x in a]
        (ka, ra), (kb, rb) = bucket_keys(np.array(a, np.uint64)), bucket_keys(np.array(b, np.uint64))
        have = {}
        for k, r in zip(ka.tolist(), ra.tolist()):
            have.setdefault(r, set()).add(k)
        met = {r for k, r in zip(kb.tolist(), rb.tolist()) if k in have[r]}
        assert len(met) == 3000


def test_components(spark):
    pick = random.Random(4)
    links = [(i, i + 1) for i in range(0, 400)] + [(500 + pick.randrange(300), 500 + pick.randrange(300)) for _ in range(250)] + [(2000, k) for k in range(2001, 2600)] + [(9, 9)]
    found = {r.id: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for link in links for n in link}
    for _ in range(len(root)):
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    assert all(found.get(n, n) == root[n] for n in root)


def test_many_prints_in_one_bucket(spark):
    """Prints that agree in two segments: a group around each of some centres, and lone ones."""
    pick, low = random.Random(5), (1 << 42) - 1
    base = pick.getrandbits(42)
    tops = {pick.getrandbits(22) for _ in range(150)}
    tops |= {t ^ 1 << pick.randrange(22) for t in list(tops)[:60] for _ in range(4)}
    prints = sorted((t << 42) | base for t in tops)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    keys, whose = bucket_keys(np.array(prints, np.uint64))
    keyed = spark.createDataFrame([(k, signed[w]) for k, w in zip(keys.tolist(), whose.tolist())], "key long, id long")
    found = {r.id: r.component for r in linked_in_buckets(keyed, None, simhash.near).collect()}
    groups = {}
    for at, root in enumerate(plain_groups(prints)):
        groups.setdefault(root, []).append(signed[at])
    assert low and all(found.get(i, i) == min(group) for group in groups.values() for i in group)


def documents():
    pick = random.Random(6)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(pick.choice([5, 40, 200, 600]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:9]] + [t.replace("w1", "v1", 1) for t in texts] + [t + " end" for t in texts] + [None, "", " ", "a", "A", "a b", "x " * 6000]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    pick.shuffle(rows)
    return rows + [rows[0], rows[1], (None, rows[2][1]), (None, "nobody else has this text at all")]


def test_documents(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, print string, component int")
    found = near_duplicates(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    groups = plain_groups(prints)
    least = {}
    for (k, _), g in zip(rows, groups):
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    wanted = sorted((str(k), p, str(least[g])) for (k, _), p, g in zip(rows, prints, groups))
    assert sorted((str(r.doc_id), r.print % 2**64, str(r.component)) for r in found) == wanted
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in least.values())


def test_buckets_are_not_broadcast(spark, monkeypatch):
    """Spark takes the keys, some 70 a fingerprint, for as large as the fingerprints: it would send them all to the driver."""
    plans = []

    def seen(*tables):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in tables)
        return cut(*tables)

    monkeypatch.setattr(components, "cut", seen)
    monkeypatch.setattr(simhash, "cut", seen)
    near_duplicates(spark.createDataFrame(documents(), "doc_id long, text string"))
    buckets = [p for p in plans if "Join" in p and "MapInArrow" in p]
    assert buckets and all("SortMergeJoin" in p and "Broadcast" not in p for p in buckets)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and keep_one(docs).count() == 0
