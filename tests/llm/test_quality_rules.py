"""Quality rules against a plain Python version."""

import random
import re
from collections import Counter

from plumbline.llm.quality_rules import RULES, Rule, judge, keep_good, order_rules, with_measures


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fives = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if fives[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    joined = "".join(words)
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    bad = (10 * len(re.findall(r"[#*$%&|<>]", joined)) > len(words) or len(joined) < 2 * len(words) or len(joined) > 20 * len(words)
           or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or 2 * len(re.findall("[A-ZÀ-ÖØ-Þ]", joined)) > len(joined)
           or 3 * len(re.findall("[0-9]", joined)) > len(joined) or 20 * len(set(words)) < len(words))
    return (len(words), len(joined), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base, not base and not bad)


def texts():
    pick = random.Random(3)
    made = [None, "", " ", "\n\n", "one", "a b c d e", "a " * 40, "a b c d e f " * 5, "x\ny\nx\n \n \nx", "ÄÖ é b c d", "\t\x0b\x0c\r a\x85b",
            "# * $ | < > & %" * 3, "😀 😀😀 x" * 4, "UPPER CASE WORDS ARE HERE FOR ALL OF US TO SEE NOW", "1 22 333 " * 9]
    for _ in range(200):
        words = [pick.choice(["the", "of", "cat", "sat", "Mat.", "|", "A", "dog###", "7"]) + str(pick.randrange(9)) * pick.randrange(2) for _ in range(pick.randrange(60))]
        made.append("".join(w + pick.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words))
    made.append(" ".join(f"w{i % 7000}" for i in range(20000)))
    return made


def test_against_plain(spark):
    given = texts() + texts()[:5]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(given)], "doc_id long, text string, words string, row int")
    found = judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(found) == len(given)
    for row in found:
        assert tuple(row)[1:] == plain(given[row.doc_id]), given[row.doc_id]


def test_kept_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}a" for i in range(40)), "x", None), (None, "short", "y", 2)], "doc_id long, text string, kept string, row int")
    kept = keep_good(docs)
    assert kept.columns == docs.columns and [r.kept for r in kept.collect()] == ["x"]


def test_no_rows(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cheap_rules_that_reject_come_first(spark):
    docs = spark.createDataFrame([(i, f"some text of number {i} and so on for a while " * 40) for i in range(600)], "doc_id long, text string")
    dear = Rule("dear", lambda m: m("joined").rlike("(s|o)*(o|m)*(e|t)*$") & (m("n_words") > 10**6))
    cheap = Rule("cheap", lambda m: m("n_words") > 10)
    assert [r.name for r in order_rules(with_measures(docs), (dear, cheap))] == ["cheap", "dear"]
    rules = order_rules(with_measures(docs), RULES, sample=100)
    assert sorted(r.name for r in rules) == sorted(r.name for r in RULES)
