import re

import pytest
from check import compare, connect

from shelfsift.llm import quality
from shelfsift.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", text or "")),
    }


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a b a a a", "x\ny\nx\n\n \nx ", "é|ü# $%&<>* Z日",
    "a b c\x1cd e \x85 f a b c\x1cd", "the same line here\n" * 60, "lorem ipsum dolor sit " * 300, "##** " * 80, "\x00 \x00 \x00 \x00",
]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in quality.quality(docs).collect():
        want = brute(TEXTS[r["doc_id"]])
        assert {m: r[m] for m in quality.MEASURES} == want, TEXTS[r["doc_id"]]
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_equals_sql(spark, folder):
    assert compare(QUERIES["op5_quality_votes"](spark, folder), connect(folder), SQL["op5_quality_votes"]) is None


def test_labelled_texts(spark, folder):
    """Without a label, the verdict on texts that pass the base test is the labelled one."""
    judged = quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).drop("quality")
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert len(rows) > 30
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_keep_good_returns_own_columns(spark):
    clean = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame(
        [(clean, None, 1), (clean, None, 1), (None, 2, 2), ("", 3, 3)], "text string, _m int, doc_id int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert quality.quality(docs.limit(0)).collect() == []
    assert quality.keep_good(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule", list(quality.RULES))
def test_rules_vote_or_abstain(spark, rule):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {r[0] for r in quality.measured(docs).select(quality.vote(rule)).collect()} <= {-1, 0, 1}
