import random
import re

import pytest

from shelfsift.llm import decontamination as de
from shelfsift.llm import words as wd


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    """[(key, n_words, n_hit, sorted items)] of all rows, every place compared with every window."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, met = words(text), set(), set()
        for known, named in windows.items():
            for i in range(len(w) - len(known) + 1):
                if tuple(w[i : i + len(known)]) == known:
                    hit |= set(range(i, i + len(known)))
                    met |= named
        out.append((key, len(w), len(hit), sorted((None if m is None else str(m) for m in met), key=lambda x: (x is None, x))))
    return sorted(out, key=repr)


def got(spark, docs, items, window, **more):
    left = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, spans string, n_words long")
    right = spark.createDataFrame([(k, t, True) for k, t in items], "item_id long, text string, items boolean")
    rows = de.contamination(left, right, window=window, **more).collect()
    for r in rows:
        edges = [e for s in r["spans"] for e in (s["start"], s["end"])]
        assert edges == sorted(set(edges)) and sum(edges[1::2]) - sum(edges[::2]) == r["n_hit"]
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr)


def random_texts(rng, n, most, letters="ab c"):
    return ["".join(rng.choice(letters) + rng.choice(["", " ", "\n", ".", "É"]) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("seed, window, shingle", [(1, 3, 2), (2, 4, 5), (3, 10, 5), (4, 2, 1)])
def test_equals_brute_force(spark, seed, window, shingle):
    rng = random.Random(seed)
    items = list(enumerate(random_texts(rng, 12, 3 * window), 1))
    docs = list(enumerate([*random_texts(rng, 40, 60), *(f"x y {t} z! {t.upper()}" for _, t in items)], 1))
    assert got(spark, docs, items, window, shingle=shingle) == brute(docs, items, window)


EDGES_ITEMS = [(1, "one two three four"), (1, "Five, six; seven eight nine"), (2, "one two three four"), (None, "zwei drei vier"), (10, "one two three four five"),
               (3, None), (4, ""), (5, " .,! "), (6, "solo"), (7, "the the the the the the")]
EDGES_DOCS = [(1, None), (1, ""), (None, "zwei drei vier"), (None, "zwei drei vier"), (2, "ONE two-three four one TWO three"), (2, "solo"), (3, "!solo?"), (4, "solos"),
              (5, "the " * 40), (6, "one two three"), (7, "four one two three"), (8, "a\x00zwei\x00drei\x7fvier "), (9, "zwei drei vier ")]


def test_edge_cases(spark):
    found = got(spark, EDGES_DOCS, EDGES_ITEMS, 4)
    assert found == brute(EDGES_DOCS, EDGES_ITEMS, 4)
    assert (2, 7, 4, ["1", "10", "2"]) in found and (None, 3, 3, [None]) in found and (9, 3, 0, []) in found


def test_blocks_give_the_same(spark, monkeypatch):
    whole = got(spark, EDGES_DOCS, EDGES_ITEMS, 4)
    monkeypatch.setattr(de, "BLOCK", 3)
    assert got(spark, EDGES_DOCS, EDGES_ITEMS, 4) == whole


def test_many_candidates_at_a_place(spark, monkeypatch):
    monkeypatch.setattr(de, "CHUNK", 2)
    items = [(i, f"a b c d{i} e") for i in range(30)] + [(99, "a b c")]
    docs = [(1, " ".join(f"a b c d{i} e" for i in range(30))), (2, "a b c " * 20)]
    assert got(spark, docs, items, 3) == brute(docs, items, 3)
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")], 3) == []
    assert got(spark, [(1, "a b")], [], 3) == [(1, 2, 0, [])]
    assert got(spark, [(1, "a b")], [(1, None)], 3) == [(1, 2, 0, [])]


def test_very_long_text_is_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(wd, "SLICE", 64)
    far = "filler word " * 30_000 + "one two three four five" + " x" * 500
    long_word = "w" * 300_000
    docs = [(1, far), (2, f"a {long_word} b"), (3, "w " * 10)]
    items = [(1, "one two three four five"), (2, f"{long_word} b")]
    assert got(spark, docs, items, 5) == [(1, 60_505, 5, ["1"]), (2, 3, 2, ["2"]), (3, 10, 0, [])]
