import hashlib

import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfsift.llm import bpe, rows
from shelfsift.llm.queries import token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "", " ", "The cat's 12 dogs!!", "ΟΔΟΣ Σ ΣΑΣ", "İstanbul ß ẞ", "é ́x à̖", "<|endoftext|>x<|startoftext|> <|endof",
    "a\x1cb\x1f c\x85d\xa0e f　g", "qzxj" * 40 + "ÿþ", "don't I'LL we'Ve 'S", "½²Ⅷ٣ १२", "日本語テキスト 한국어 ไทย", "🙂👩‍👩‍👧 !!!???", "\x00\x01﻿",
    "a" * 5000, "line\nbreak\r\n\ttab", "각 ÅΩ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert list(codec.encode(text)) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aeqzxth's<|endoftx>! ́É", max_size=60))
def test_equals_library_on_any_text(codec, library, text):
    assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_equals_library_on_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in token_digests(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))


def test_forced_cuts_exist_and_do_not_change_ids(codec):
    word = b"theqxjzvand"
    (fragments,) = codec.cut_all([word])
    assert len(fragments) > 1 and b"".join(fragments) == word + bpe.ENDED
    assert codec.merge_long(word + bpe.ENDED) == codec.encode(word.decode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aeinrsthéà", min_size=1, max_size=30), min_size=1, max_size=20), st.booleans())
def test_both_merges_agree(codec, fragments, ended):
    fragments = [f.encode() + bpe.ENDED * ended for f in fragments]
    assert codec.merges.run(fragments) == [codec.merge_long(f) for f in fragments]


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (1, "", 5), (None, "the cat", 5), (2, "the cat", None), (2, "the cat", None)], "doc_id long, text string, ids int")
    whole = bpe.round_trip(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in whole) == [
        (0, 2, "the</w> cat</w>"), (1, 0, ""), (1, 0, ""), (2, 2, "the</w> cat</w>"), (2, 2, "the</w> cat</w>")]
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in again) == sorted((r["doc_id"] or 0, r["decoded"]) for r in whole)
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []


def test_a_task_gives_its_memory_back():
    """What a task has freed does not stay with its Python worker while later stages run."""
    def resident() -> int:
        with open("/proc/self/status") as f:
            return int(next(line for line in f if line.startswith("VmRSS")).split()[1]) >> 10

    top = []

    def work(source):
        texts = [bytes(1000) for _ in range(200_000)]
        top.append(bytes(1000))  # lies above the others, so that the heap cannot shrink
        yield from source
        del texts

    before = resident()
    list(rows.thrifty(work)(iter([pa.record_batch({"x": [1]})])))
    assert resident() - before < 60
