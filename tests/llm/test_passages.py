import hashlib
import random
import re

import numpy as np
import pytest

from shelfsift.llm import passages, phrases
from shelfsift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(n_words, n_removed, kept) of each text, in key order."""
    first, out = {}, []
    words = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check(spark, texts, window):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in passages.remove_passages(docs, window=window).collect()}
    assert got == dict(enumerate(brute(texts, window)))


@pytest.mark.parametrize("window", [16, 25, 50])
def test_random_copies_equal_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 5000)
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "#", "x\x1cy"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(window // 2, 4 * window))] for _ in range(10)]
    texts = []
    for _ in range(60):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice([rng.choice(shared), [rng.choice(vocabulary) for _ in range(rng.randint(0, window))]])]
        if words and rng.random() < 0.4:
            words[rng.randrange(len(words))] = "edit"
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    check(spark, texts, window)


def test_periods_inside_and_across(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 100)
    rng = random.Random(3)
    tale = [f"t{rng.randrange(40)}" for _ in range(900)]
    check(spark, [
        "a " * 49, "a " * 50, "a " * 500, "a b " * 200, None, " \n", " ".join(tale), " ".join(tale[100:200]) + " q " + " ".join(tale[150:700]),
        " ".join(tale + tale), "b a " * 60, "a b c " * 60, "a b c " * 61, " ".join(tale[:49]), " ".join(tale[:50]),
    ], 50)


def test_documents_equal_brute_force(spark, folder):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    want = brute([t for _, t in rows], 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op9_remove_passages"](spark, folder).collect()}
    assert got == {i: (*w[:2], hashlib.sha256(w[2].encode()).hexdigest()) for (i, _), w in zip(rows, want)}
    assert sum(w[1] for w in want) > 0


def test_word_numbers_tell_words_apart(monkeypatch):
    words = ["a", "aa", "aaa", "b", "ab", "ba", "\x00", "\x00\x00", "é", "e"]
    one = passages.word_numbers(" ".join(words).encode())
    assert len(set(one.tolist())) == len(words)
    assert (passages.word_numbers(("\n\t".join(words) + " ").encode()) == one).all()
    before = passages.word_numbers(("pad " * 50 + "x" * 900 + " end").encode())
    monkeypatch.setattr(passages, "PIECE", 64)
    assert (passages.word_numbers(("pad " * 50 + "x" * 900 + " end").encode()) == before).all()


def test_automaton_finds_stems_of_other_texts():
    words = [np.arange(100, 140, dtype=np.uint64), np.concatenate([np.arange(5), np.arange(110, 130)]).astype(np.uint64)]
    found = passages.locate(words, [np.array([12]), np.zeros(0, np.int64)], 6)
    assert [f.tolist() for f in found] == [[12], [7]]


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, text, 1), (1, text, 2), (1, text, 3), (None, text, 4), (None, None, 5)], "doc_id long, text string, kept int")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in passages.remove_passages(docs).collect())
    assert got == [(0, 0), (0, 60), (1, 0), (1, 60), (2, 60)]
    assert passages.remove_passages(docs.limit(0)).collect() == []


def test_long_words_of_like_structure_are_told_apart(spark):
    """Letters a and b in the Thue-Morse order and its opposite: their polynomials agree modulo 2 ** 64."""
    for letters in (64, 1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(letters))
        other = one.translate(str.maketrans("ab", "ba"))
        numbers = passages.word_numbers(f"{one} {other} {one}".encode())
        assert numbers[0] == numbers[2] != numbers[1]
        around = [f"w{i}" for i in range(60)]
        docs = [(1, " ".join([*around[:30], one, *around[30:]])), (2, " ".join([*around[:30], other, *around[30:]]))]
        got = passages.remove_passages(spark.createDataFrame(docs, "doc_id long, text string"), window=50).collect()
        assert all(r["n_removed"] == 0 for r in got)
