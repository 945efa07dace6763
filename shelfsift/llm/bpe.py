"""Byte-pair encoding by forced-boundary splitting, and decoding.

Two neighbouring byte symbols that stand side by side in no token of the vocabulary can never be
merged, nor can anything across them: every merge gives a token. So a word may be cut there, the
fragments encoded each on its own - and each distinct fragment only once - and the ids put one after
the other. White space is such a boundary as well.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from shelfsift.llm.rows import thrifty

END = "</w>"
ENDED = b"\xff"  # stands behind the bytes of a fragment that ends its word; no UTF-8 text holds it
MOST_CACHED = 100_000
SHORT = 40
PIECE = 1 << 20  # bytes of text, or ids, worked on at once

# The word pattern of this kind of vocabulary file, and Unicode's white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]

ON_WHITE = regex.compile(f"[{WHITE}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split() also splits at these, which are no white space in Unicode
LATIN = regex.compile("[\x00-\u024f]*")
WORD_OR_BREAK = regex.compile(WORD + r"|\n")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    unprinted = [b for b in range(256) if b not in PRINTED]
    return {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(unprinted)}


def neighbours(symbols) -> Iterator[tuple]:
    return zip(symbols, symbols[1:])


class Recent:
    """A bounded memo of two generations: what has not been asked for lately is worked out again."""

    def __init__(self):
        self.newer, self.older = {}, {}

    def known(self, keys: set) -> dict:
        """The known ones of ``keys``."""
        newer, older = self.newer.get, self.older.get
        return {k: v for k in keys if (v := newer(k) or older(k)) is not None}

    def add(self, found: dict) -> None:
        if len(self.newer) > MOST_CACHED:
            self.older, self.newer = self.newer, {}
        self.newer.update(found)


class Merges:
    """Merges many short fragments at once: one row of token ids each, one merge per row and round."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + END] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.none = len(pairs)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        # An open hash table from pairs to ranks: some twenty slots per entry, so runs are short.
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(pairs)) * 20))))
        self.keys, self.ranks, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64), 1
        keys = self.key(pairs[:, 0], pairs[:, 1])
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            probes = 1
            while self.keys[slot] >= 0:
                slot, probes = (slot + 1) & ((1 << self.bits) - 1), probes + 1
            self.keys[slot], self.ranks[slot], self.probes = key, rank, max(self.probes, probes)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left << 32 | right

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``none`` where there is no merge or no right-hand token (-1)."""
        key = self.key(left, right)
        slot = self.slot(key)
        found = np.where((self.keys[slot] == key) & (right >= 0), self.ranks[slot], self.none)
        for _ in range(self.probes - 1):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = np.where((self.keys[slot] == key) & (right >= 0), self.ranks[slot], found)
        return found

    def run(self, fragments: list[bytes]) -> list[array]:
        """Ids per fragment, which is bytes, with ENDED behind them if it ends its word."""
        if not fragments:
            return []
        lengths = np.array(list(map(len, fragments)))
        out: list[array] = [None] * len(fragments)
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            width = int(lengths[rows[0]])
            codes = np.frombuffer(b"".join([fragments[i] for i in rows]), np.uint8).reshape(len(rows), width)
            ended = codes[:, -1] == ENDED[0]
            for end in (True, False):
                if not (ended == end).any():
                    continue
                own, n = codes[ended == end], width - end
                ids = np.full((len(own), n + 1), -1, np.int64)  # a column of -1 stands behind the last token
                ids[:, :n] = self.inner[own[:, :n]]
                if end:
                    ids[:, n - 1] = self.last[own[:, n - 1]]
                for i, row in zip(rows[ended == end].tolist(), self.merge(ids)):
                    out[i] = row
        return out

    def merge(self, ids: np.ndarray) -> list[array]:
        done, width = ids.copy(), ids.shape[1]
        at, place = np.arange(len(ids)), np.arange(width - 1)
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        while len(at):
            first = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, first[:, None], 1)[:, 0]
            stay = best < self.none
            done[at[~stay]] = ids[~stay]
            at, ids, ranks, first, best = at[stay], ids[stay], ranks[stay], first[stay], best[stay]
            if not len(at):
                break
            row = np.arange(len(at))
            step = place[None, :] > first[:, None]
            # Close the gap behind the merged pair, then rank its two new neighbours.
            ids[:, :-1] = np.where(step, ids[:, 1:], ids[:, :-1])
            ids[row, first] = self.merged[best]
            ranks[:, :-1] = np.where(step[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.none
            ranks[row, first] = self.rank(ids[row, first], ids[row, first + 1])
            back = np.maximum(first - 1, 0)
            ranks[row, back] = np.where(first > 0, self.rank(ids[row, back], ids[row, back + 1]), ranks[row, back])
        sizes = (done >= 0).sum(axis=1).tolist()
        return [array("i", x[:n]) for x, n in zip(done.tolist(), sizes)]


class Codec:
    """Encodes and decodes with a vocabulary file (JSON: vocab, merges, added tokens) of a word-end BPE."""

    def __init__(self, definition: str):
        parts = json.loads(definition)
        self.ids = parts["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        self.symbols = byte_symbols()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split_words = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.merges = Merges(self.ids, merges)
        # Which bytes stand side by side in some token, and which two end some token that ends a word.
        self.inner, self.final = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        byte_of = {symbol: b for b, symbol in self.symbols.items()}
        for token in self.ids:
            ends = token.endswith(END) and token != END
            inside = [byte_of[c] for c in (token[: -len(END)] if ends else token)]
            for a, b in neighbours(inside[:-1] if ends else inside):
                self.inner[a, b] = True
            if ends and len(inside) > 1:
                self.final[inside[-2], inside[-1]] = True
        self.runs = Recent()

    def encode(self, text: str | None) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """Tokens joined by single spaces, special ones included; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def encode_all(self, texts: list[str | None]) -> list[array]:
        """Ids of every text."""
        ids, ends = self.encode_flat(texts)
        return [array("i", ids[a:b].tobytes()) for a, b in neighbours(ends.tolist())]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where they begin and end. Each distinct run without white space, each distinct word and fragment is worked out once."""
        split = [self.white_split(t) if t else [] for t in texts]
        wanted = set().union(*split)
        ids_of = self.runs.known(wanted)
        new = self.run_words([run for run in wanted if run not in ids_of])
        word_ids = self.word_ids({word for words in new.values() for word in words})
        for run, words in new.items():
            if len(words) == 1:
                ids_of[run] = word_ids[words[0]]
            else:
                ids_of[run] = ids = array("i")
                for word in words:
                    ids.extend(word_ids[word])
        self.runs.add(ids_of)
        # The ids of the distinct runs lie one after another; each run of a text takes its stretch of them.
        place = dict(zip(ids_of, range(len(ids_of))))
        known = np.frombuffer(b"".join(ids_of.values()), np.int32)
        sizes = np.fromiter(map(len, ids_of.values()), np.int64, len(ids_of))
        runs = np.cumsum([0, *map(len, split)])
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(runs[-1]))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[at])])
        shift = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        return known[np.repeat(shift, sizes[at]) + np.arange(ends[-1])], ends[runs]

    @staticmethod
    def white_split(text: str) -> list[str]:
        return [x for x in ON_WHITE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def run_words(self, runs: list[str]) -> dict[str, list[str]]:
        """The words of each run, composed and lower-cased; a special token in it stands for itself."""
        whole = "\n".join(runs)
        odd = not LATIN.fullmatch(whole) or (self.special is not None and self.special.search(whole))
        plain = [r for r in runs if LATIN.fullmatch(r) and not (self.special is not None and self.special.search(r))] if odd else runs
        found: dict[str, list[str]] = {}
        if plain:
            # One pass over all plain runs; no Latin letter depends on its neighbours when lower-cased.
            words: list[str] = []
            rest = iter(plain)
            for word in WORD_OR_BREAK.findall(unicodedata.normalize("NFC", "\n".join(plain)).lower()):
                if word == "\n":
                    found[next(rest)] = words
                    words = []
                else:
                    words.append(word)
            found[next(rest)] = words
        if odd:
            found.update((r, self.odd_words(r)) for r in runs if r not in found)
        return found

    def odd_words(self, run: str) -> list[str]:
        """The same for one run, beyond Latin with the tables of the tokenizers library."""
        parts = [part for part in self.special.split(run) if part] if self.special else [run]
        return [word for part in parts for word in (
            [part] if part in self.specials else [w for w, _ in self.split_words.pre_tokenize_str(self.normal.normalize_str(part))])]

    def word_ids(self, words: set[str]) -> dict[str, array]:
        known = {s: array("i", [i]) for s, i in self.specials.items()}
        fresh = [word for word in words if word not in known]
        cut = self.cut_all([word.encode("utf-8", "replace") for word in fresh])
        ids = self.fragment_ids({fragment for fragments in cut for fragment in fragments})
        for word, fragments in zip(fresh, cut):
            if len(fragments) == 1:
                known[word] = ids[fragments[0]]
            else:
                known[word] = whole = array("i")
                for fragment in fragments:
                    whole.extend(ids[fragment])
        return known

    def cut_all(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word cut between bytes that no token holds side by side."""
        if not words:
            return []
        ends = np.cumsum(list(map(len, words)))
        codes = np.frombuffer(b"".join(words), np.uint8)
        joined = self.inner[codes[:-1], codes[1:]]
        joined[ends[:-1] - 1] = True  # between two words
        two = np.diff(ends, prepend=0) > 1
        joined[ends[two] - 2] = self.final[codes[ends[two] - 2], codes[ends[two] - 1]]
        out = [[word + ENDED] for word in words]
        cuts = np.flatnonzero(~joined) + 1
        owners, first = np.unique(np.searchsorted(ends, cuts, "right"), return_index=True)
        for i, own in zip(owners.tolist(), np.split(cuts, first[1:])):
            word, start = words[i], int(ends[i]) - len(words[i])
            at = [0, *(own - start).tolist(), len(word)]
            out[i] = [word[a:b] for a, b in neighbours(at)]
            out[i][-1] += ENDED
        return out

    def fragment_ids(self, fragments: set[bytes]) -> dict[bytes, array]:
        short = [f for f in fragments if len(f) <= SHORT]
        return dict(zip(short, self.merges.run(short))) | {f: self.merge_long(f) for f in fragments if len(f) > SHORT}

    def merge_long(self, fragment: bytes) -> array:
        """Merges of the lowest rank first, leftmost first, by a heap: n log n for a fragment of n bytes."""
        parts = [self.symbols[b] for b in fragment.removesuffix(ENDED)]
        if fragment.endswith(ENDED):
            parts[-1] += END
        ranks = self.ranks
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = [(ranks[p], i) + p for i, p in enumerate(neighbours(parts)) if p in ranks]
        heapq.heapify(waiting)

        def push(i: int, left: str, right: str) -> None:
            if (left, right) in ranks:
                heapq.heappush(waiting, (ranks[left, right], i, left, right))

        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                push(i, parts[i], parts[after[i]])
            if before[i] >= 0:
                push(before[i], parts[before[i]], parts[i])
        return array("i", [self.ids[p] for p in parts if p is not None])


def _run(df: DataFrame, path: str, column: str, made: dict[str, T.DataType], work: Callable) -> DataFrame:
    """``work(codec, values)`` on pieces of ``column`` of a (key, column) table; the key travels along."""
    with open(path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != column]

    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(definition.value)
        for batch in source:
            values = batch.column(column)
            lengths = pc.binary_length(values) if pa.types.is_string(values.type) else pc.list_value_length(values)
            sizes = np.cumsum(pc.fill_null(lengths, 0).to_numpy().astype(np.int64))
            edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // PIECE)) + 1, [batch.num_rows]])).tolist()
            for at, end in neighbours(edges):
                piece = batch.slice(at, end - at)
                new = work(codec, piece.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *new], [*kept, *made])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memos are large and nothing here makes cycles: each collection would walk all of them in vain
        try:
            yield from pieces(source)
        finally:
            gc.enable()  # the worker goes on to other tasks

    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in made.items())])
    return df.mapInArrow(thrifty(batches), schema)


def _encoded(codec: Codec, texts: list[str | None]) -> tuple[pa.Array, list[list[int]]]:
    ids, ends = codec.encode_flat(texts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), [ids[a:b].tolist() for a, b in neighbours(ends.tolist())]


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every whole text, a null or blank one without any.

    ``path`` names a vocabulary file the driver can read; it goes to the executors as a broadcast of a
    few megabytes, whatever the size of the corpus. Rows are handled one by one, so equal rows, null
    keys and an empty table need no care; other columns are not read. The text of a special token
    stands for that token.
    """
    return _run(docs.select(key, text), path, text, {"ids": IDS}, lambda codec, texts: [_encoded(codec, texts)[0]])


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): tokens joined by a space, special ones too; null ids give an empty text."""
    return _run(
        encoded.select(key, ids), path, ids, {"decoded": TEXT},
        lambda codec, lists: [pa.array([codec.decode(x or ()) for x in lists], pa.string())])


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): :func:`encode` and :func:`decode` of its ids in one pass over the texts."""

    def work(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        ids, lists = _encoded(codec, texts)
        return [ids, pa.array([codec.decode(x) for x in lists], pa.string())]

    return _run(docs.select(key, text), path, text, {"ids": IDS, "decoded": TEXT}, work)
