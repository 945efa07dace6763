import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfsift.llm import simhash
from shelfsift.llm.queries import QUERIES


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """{id: smallest linked id} of {id: fingerprint}, all pairs compared."""
    ids = sorted(prints)
    name = {i: i for i in ids}

    def root(i):
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b", "a B c", "É a b É a b", "x\x1cy z\x85w q", "a b c " * 50, "AB ab aB " * 7])
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text, 3) % (1 << 64) == brute(text)


def test_documents_equal_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute(r["text"]) for r in rows}
    want = components(prints)
    got = QUERIES["op4_simhash_near_duplicates"](spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9])
def test_links_keep_every_component(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    base = [xxh64_intdigest(str(i)) for i in range(40)] + [0, 2**64 - 1]
    values = {x ^ (1 << (k * 7 + i) % 64) ^ (1 << (k * 13) % 64) for i, x in enumerate(base) for k in range(radius + 2)} | set(base)
    signed = {v: v - (1 << 64) * (v >> 63) for v in values}
    table = spark.createDataFrame([(s,) for s in signed.values()], "fingerprint long").select("fingerprint")
    pairs = simhash.links(table, radius).collect()
    back = {s: v for v, s in signed.items()}
    name = {v: v for v in values}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for r in pairs:
        a, b = sorted((root(back[r["a"]]), root(back[r["b"]])))
        name[b] = a
    want = components({v: v for v in values}, radius)
    assert {frozenset(v for v in values if root(v) == n) for n in {root(v) for v in values}} == {
        frozenset(v for v in values if want[v] == n) for n in set(want.values())}


def test_edges_and_first_rows(spark):
    long_text = "word other third " * 20_000
    docs = spark.createDataFrame(
        [(5, "a b c d", "x"), (3, "A b C d", None), (3, "a b c d", "y"), (None, "a b c d", "z"), (7, None, "e"), (8, " ", "f"), (None, "q r s t u", "g"), (9, long_text, "h"), (9, long_text, "h")],
        "doc_id long, text string, component_id string")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (None, None), (9, 9)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_first(docs.limit(0)).collect() == []
    assert simhash.near_duplicates(docs.where(F.col("doc_id") == 5)).collect()[0]["component_id"] == 5


def test_one_row_of_each_component_whatever_the_keys(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(300)) for name in "abcdef"}
    docs = [
        (None, texts["a"], "a1"), (None, texts["b"], "b1"), (None, texts["b"].upper(), "b2"),  # components without any key
        (3, texts["c"], "c1"), (None, texts["c"], "c2"), (4, texts["c"], "c3"),
        (3, texts["d"], "d1"),  # another text of the same key
        (5, texts["e"], "e1"), (5, texts["f"], "f2"), (1, texts["f"], "f1"),  # the copy in f is not brought back by e
    ]
    kept = simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string, name string"))
    found = sorted(r["name"] for r in kept.collect())
    assert [n for n in found if n[0] != "b"] == ["a1", "c1", "d1", "e1", "f1"] and len(found) == 6


def test_text_keys_and_other_columns(spark):
    docs = spark.createDataFrame([("y", "p q r s", {"m": 1}), ("x", "p q r s", {"m": 2}), (None, "t u v w", None)], "doc_id string, text string, more map<string,int>")
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or "", r["more"]) for r in kept.collect()) == [("", None), ("x", {"m": 2})]
