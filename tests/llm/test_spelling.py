import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from shelfsift.llm import spelling as sp
from shelfsift.llm import words as wd


def brute_counts(docs, one_in=97, min_letters=5, min_count=3):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_letters:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """{word: (n, n_near, form, form_n, root)}"""
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(others), form, counts.get(form))
    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return {w: (*v, root(w)) for w, v in out.items()}


def solved(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = sp.with_roots(sp.variants(words)).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def random_words(seed, size, letters, lengths):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([3, 3, 4, 6, 8, 16, 50, 200]) for _ in range(size)}


@pytest.mark.parametrize("seed, letters, lengths", [(1, "abc", [5, 6]), (2, "abcdé", [5, 6, 7]), (3, "ab", range(1, 9)), (4, "abcŁ\U0001F600", [3, 4]), (5, "etaoin", [5, 9])])
def test_equals_brute_force(spark, seed, letters, lengths):
    counts = random_words(seed, 400, letters, lengths)
    assert solved(spark, counts) == brute(counts)


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(sp, "TILE", 7)
    counts = random_words(6, 300, "ab", range(4, 10))
    pairs = sp.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    found = [tuple(sorted((r["word"], r["near"]))) for r in pairs]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in counts for b in counts if a < b and near(a, b)}


def test_letters_of_one_dimension(spark):
    other = chr(ord("a") + sp.DIMS)
    counts = {"aaaaa": 10, f"aaaa{other}": 3, f"aaaaa{other}": 4, "aaaaaa": 30}
    assert solved(spark, counts) == brute(counts)


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 1000)
    base = "ab" * 3000
    counts = {base: 9, base[:-1] + "c": 3, base + "x": 4, "y" + base: 100, base[::-1]: 5, "yyyyy": 3}
    assert solved(spark, counts) == brute(counts)


def test_chains_ties_and_no_words(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 192, "cbbbbb": 192, "zzzzz": 4, "zzzzy": 8, "zzzzx": 8, "lonely": 5}
    want = brute(counts)
    assert want["aaaaa"][-1] == "bbbbbb" and want["zzzzz"][2] == "zzzzx"
    assert solved(spark, counts) == want
    assert solved(spark, {"word": 3}) == {"word": (3, 0, None, None, "word")}
    assert solved(spark, {}) == {}


DOCS = [(1, None), (1, ""), (None, "Straße straße STRASSE ÉCOLE école École"), (2, "don't DON'T co-operate"), (2, "×××××÷ ×××××÷ ×××××÷"), (3, "İstanbul ŁÓDŹ")]


def test_counts_of_words(spark):
    rng = random.Random(7)
    docs = DOCS + [(i, " ".join(rng.choice(["hello", "Hellos", "wörld", "ÀÉÎ", "aaaaaa", "bbbbb2ccccc"]) for _ in range(40))) for i in range(60)]
    table = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, n long")
    for one_in, least in ((97, 3), (3, 1), (1, 1)):
        got = sp.word_counts(table, one_in=one_in, min_count=least).collect()
        assert {r["word"]: r["n"] for r in got} == brute_counts(docs, one_in, 5, least)
    assert sp.word_counts(table.limit(0)).collect() == []


def test_very_long_text_and_small_memory(spark, monkeypatch):
    monkeypatch.setattr(wd, "SLICE", 50)
    monkeypatch.setattr(sp, "MOST_COUNTED", 3)
    docs = [(1, "alpha beta gamma delta " * 20_000), (2, "x" * 200_000 + " alpha"), (3, "x" * 200_000), (4, "x" * 200_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in sp.word_counts(table).collect()}
    assert got == brute_counts(docs) and got["alpha"] == 20_001


def test_squared_distances_are_exact():
    words = ["a" * 2000 + "b", "a" * 2000 + "c", "a" * 2001]
    assert sorted(map(tuple, sp.near_in_unit(1, words, np.zeros(3, int), np.zeros(sp.DIMS, int)).tolist())) == [(0, 1), (0, 2), (1, 2)]
