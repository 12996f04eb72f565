"""The trie against plain lists of turns."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm.prefix_trie import read_turns, share_openings, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string, conv string"


def plain(rows, opened=True):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    original = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in said.items()}
    rebuilt = original
    if opened:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in original}
        rebuilt = {c: original.get(c - c % 20, [])[:h[c]] + turns[h[c]:] for c, turns in original.items()}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, of in members.items():
        words = len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(of) - 1) * words
            leaves[path[:d]] += not children[path]
    ends = {p: ",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(p)) for p, of in members.items()}
    return sorted((min(of), len(p), min(members[p[:-1]]) if p else -1, len(of), children[p], leaves[p], saved[p],
                   hashlib.sha256(ends[p].encode()).hexdigest()) for p, of in members.items())


def found(spark, rows, block=4, opened=True, parts=3):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)
    turns = read_turns(table)
    conv = F.col("conv")
    made = (share_openings(turns, F.crc32(conv.cast("string")) % 4, conv - conv % 20, 3) if opened
            else (turns, turns.select("conv").distinct()))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in trie(*made, block).collect())


def talks(n, most, choices):
    """Conversations of up to `most` turns with few different ones, so that many share beginnings."""
    state, rows = 7, []
    for c in range(n):
        state = state * 1103515245 + 12345 & 0x7FFFFFFF
        for turn in range(state % (most + 1)):
            state = state * 1103515245 + 12345 & 0x7FFFFFFF
            which = state // 7 % (1 if turn % 5 else choices)
            rows.append((c * 3 if c % 7 else c * 20, turn * 2, ("user", "assistant", None)[turn % 3], f"turn {turn} choice {which} " + "w " * which if which else None))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
@pytest.mark.parametrize("opened", [True, False])
def test_talks(spark, block, opened):
    rows = talks(60, 14, 3)
    assert found(spark, rows, block, opened) == plain(rows, opened)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no key"), (1, None, "user", "null comes first"), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (2, 0, "a", "b c"),
            (22, 0, "ab", " c"), (40, 0, "a", "bc"), (41, 5, "", "x\ty\n z w"), (42, 5, None, "x\ty\n z w"), (43, -3, "user", "ein wort"), (60, 9, "u", "one"), (61, 9, "u", "one")]
    for opened in (True, False):
        assert found(spark, rows, 4, opened) == plain(rows, opened)


def test_equal_turn_numbers_have_an_order(spark):
    rows = [(c, 1, "user", text) for c in (7, 8, 9) for text in ("b", "a", "c", "a")]
    assert found(spark, rows, 2, False) == found(spark, rows[::-1], 2, False, 5)
    assert {r[3] for r in found(spark, rows, 2, False)} == {3}


def test_only_turnless_conversations(spark):
    """One turn each, which the opening of an absent conversation replaces with nothing."""
    rows = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert len(rows) > 3 and found(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_many_equal_conversations_and_a_long_one(spark):
    """Ends of a node in several pieces; a conversation of many blocks."""
    rows = [(c * 37, t, "user", f"turn {t}") for c in range(1500) for t in range(2)] + [(5, t, "user", f"turn {t}") for t in range(700)]
    assert found(spark, rows, 4, False) == plain(rows, False)


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
