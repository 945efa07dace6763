import hashlib
import random

import pytest

from shelfsift.llm import phrases, suffixes
from shelfsift.llm.queries import QUERIES


def brute(rows, length):
    """{position in rows: (n_bytes, n_removed, n_spans, kept)}; rows in key order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def check(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(docs, length=length).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def pieces(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("length", [16, 20, 37, 100])
def test_random_copies_equal_brute_force(spark, length):
    rng = random.Random(length)
    shared = [pieces(rng, "abcdefghij é", rng.randint(length // 2, 4 * length)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([rng.choice(shared), pieces(rng, "abcdefghij é", rng.randint(0, 2 * length))]) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    check(spark, texts, length)


def test_runs_and_periods(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 700)
    monkeypatch.setattr(phrases, "BATCH", 2000)
    rng = random.Random(1)
    long_text = pieces(rng, "xyz ", 3000)
    check(spark, [
        "a" * 99, "a" * 100, "a" * 101, "a" * 2500, "ab" * 300, "abc" * 200 + "a" * 120, None, "", long_text, long_text[500:900], "q" + long_text[100:2700] + "q",
        long_text + long_text, "\x00" * 300, "\x00" * 150 + "b", "é" * 120, long_text[:1500],
    ], 100)


def test_documents_equal_brute_force(spark, folder):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    want = brute([t for _, t in rows], 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op10_remove_repeats"](spark, folder).collect()}
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, want)}
    assert sum(w[1] for w in want) > 0


def test_edges(spark):
    text = "some words that are long enough " * 1 + "0123456789" * 12
    docs = spark.createDataFrame([(2, text, 1), (1, text, 2), (1, text, 3), (None, text, 4), (None, None, 5)], "doc_id long, text string, kept int")
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.remove_repeats(docs).collect()))
    (first,) = {brute([text], 100)[0][1]}
    assert got == [(0, 0), (0, len(text)), (1, first), (1, len(text)), (2, len(text))]
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, length=8)
