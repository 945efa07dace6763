import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm import test_quality, test_simhash, test_suffixes
from shelfsift.llm import mixing


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets of sources in order, by sharing out again what is cut off."""
    total, targets, open_ = sum(sizes.values()), {}, dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while True:
        rest = total - sum(targets.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return targets | {s: level * weight[s] for s in open_}
        for s in over:
            targets[s] = most * open_.pop(s)


def copies(docs):
    """{doc_id: times taken} of {doc_id: (source, words)}."""
    sizes = defaultdict(int)
    for source, n in docs.values():
        sizes[source] += n
    out = Counter()
    for source, target in shares(sizes).items():
        budget = int(target + 1e-6)
        own = sorted((d for d, (s, _) in docs.items() if s == source), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        for d in own:
            n = docs[d][1]
            if n:
                out[d] = epochs + (rest > 0)
                rest -= n
    return out


def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, "é": 5, None: 7, "z": 0, "Z": 900}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows, "source", (1, 2, 3), 3).collect()}
    want = shares(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_stages_equal_brute_force(spark, folder):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(_again(spark, stage(spark, frames[-1], folder)))
    raw, good, firsts, cut, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    for f in frames[1:5]:
        assert f.columns == docs.columns

    measured = {r["doc_id"]: test_quality.brute(r["text"]) for r in raw}
    passed = {i for i, m in measured.items() if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert kept <= passed
    assert {i for i in passed if quality.get(i) == 1} <= kept
    assert not {i for i in kept if quality.get(i) == 0}

    names = test_simhash.components({r["doc_id"]: test_simhash.brute(r["text"]) for r in good})
    assert sorted(r["doc_id"] for r in firsts) == sorted(set(names.values()))

    ordered = sorted(firsts, key=lambda r: r["doc_id"])
    want = {r["doc_id"]: w[3].decode("utf-8", "ignore") for r, w in zip(ordered, test_suffixes.brute([r["text"] for r in ordered], 100))}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut} == {i: (t, len(t)) for i, t in want.items()}

    times = copies({r["doc_id"]: (r["source"], len(test_quality.WORD.findall(r["text"]))) for r in cut})
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in times.items() if n})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed)
    for r in tokens:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"])


def _again(spark, df):
    """Written and read, as a run does."""
    from shelfsift.session import scratch_path

    path = scratch_path(spark, "test-stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_edges_of_every_stage(spark, folder):
    text = " ".join(f"word{i} is here" for i in range(60))
    docs = spark.createDataFrame(
        [(None, text, "en", None, 5, "a"), (1, text, None, "s", None, "b"), (1, text, None, "s", None, "b"), (2, None, None, None, None, None), (3, "", "x", "s", 0, "c"), (4, text.upper().lower() + " tail end", "x", "t", 1, "d")],
        "doc_id long, text string, lang string, source string, n_chars long, _c0 string")
    for rows in (docs, docs.limit(0)):
        frame = rows
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, rows, folder)
            assert name == "bpe_encoding" or alone.columns == docs.columns
            alone.collect()
            frame = _again(spark, stage(spark, frame, folder))
        frame.collect()
