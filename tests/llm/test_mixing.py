from check import compare, connect
from pyspark.sql import functions as F

from shelfsift.llm import mixing
from shelfsift.llm.queries import QUERIES, SQL
from shelfsift.llm.words import n_words, words


def test_equals_sql(spark, folder):
    assert compare(QUERIES["op8_mix_sources"](spark, folder), connect(folder), SQL["op8_mix_sources"]) is None


def test_budgets_are_met_to_the_word(spark, folder):
    rows = QUERIES["op8_mix_sources"](spark, folder).collect()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[docs[r["doc_id"]]] = taken.get(docs[r["doc_id"]], 0) + r["taken"]
        target[docs[r["doc_id"]]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (None, "d e", None, 2), (None, "d e", None, 2), (2, None, "t", 3), (3, " \n", "t", 4), (4, "x " * 50_000, "u", 5)],
        "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, n_words(F.col("text"))).collect()
    assert len(got) == 7
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["source"] == "t"} == {0}
    assert mixing.mix(docs.limit(0), n_words(F.col("text"))).collect() == []
    again = mixing.mix(docs.repartition(3), n_words(F.col("text"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_words(spark):
    texts = [None, "", " ", "a", " a\tb\x0b\x0c\rc\n", "a\x1cb\x85c\xa0d e"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in docs.select("i", words(F.col("t")).alias("w")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["a"], 4: ["a", "b", "c"], 5: ["a\x1cb\x85c\xa0d", "e"]}
