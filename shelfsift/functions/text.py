"""Text normalisation, tokens, n-grams and fixed-length sequences as native columns.

Every function takes and returns a Column, so all of it runs inside the JVM. A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character sets and patterns that decide what a token is.
KEPT = "[a-z0-9 ]"
NOT_KEPT = r"[\x{0}-\x{1F}!-/:-`{-\x{10FFFF}]"  # all but KEPT; as ranges the JVM matches it 7 times faster than [^...]
NOT_ASCII_ALNUM = r"[\x{0}-/:-`{-\x{10FFFF}]"
WORD_GAP = r"[^\p{L}\p{N}]+"
WHITESPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"
NOT_WHITESPACE = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
CHAR_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
NOISE_PATTERN = r"[0-9]+|\p{Punct}|ï|½|®"
FEATURE_WORD = r"[\p{L}\p{N}_]{2,}"
PATH_SEPARATOR = " > "


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def _over_range(n: Column, body: Callable[[Column], Column]) -> Column:
    """``[body(1), ..., body(n)]``, empty for n < 1."""
    return F.slice(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), body), F.lit(1), F.greatest(n, F.lit(0)))


def like_text(wanted: str) -> str:
    """A pattern for ``like`` that takes ``wanted`` literally, anywhere in the text."""
    return "%" + "".join("\\" + c if c in "%_\\" else c for c in wanted) + "%"


# -- normalisation ---------------------------------------------------------------------------


def process_string(c: Column | str) -> Column:
    """Lower-case, then delete everything outside a-z, 0-9 and space. Runs of spaces stay."""
    return F.regexp_replace(F.lower(_as_column(c)), NOT_KEPT, "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_as_column(c), " +", " ")


def strip_spaces(c: Column | str) -> Column:
    return F.replace(_as_column(c), F.lit(" "), F.lit(""))


def split_tokens(c: Column | str) -> Column:
    """Split at white space without changing case; no empty tokens."""
    return F.array_remove(F.split(_as_column(c), WHITESPACE), "")


def has_token(c: Column | str) -> Column:
    """Whether a text holds anything but white space, without splitting it."""
    return F.rlike(_as_column(c), F.lit(NOT_WHITESPACE))


def tokens_ws(c: Column | str) -> Column:
    return split_tokens(F.lower(_as_column(c)))


def tokens_replace(c: Column | str) -> Column:
    """Every run of characters that are neither letters nor digits separates two tokens."""
    return F.array_remove(F.split(_as_column(c), WORD_GAP), "")


def tokens_delete(c: Column | str) -> Column:
    """Delete all but a-z, 0-9 and space *without* lower-casing first, so capitals vanish."""
    return F.array_remove(F.split(F.regexp_replace(_as_column(c), NOT_KEPT, ""), " "), "")


def r_clean(c: Column | str) -> Column:
    """Digits, punctuation and stray symbols to spaces, lower-case, no words of one or two letters."""
    spaced = F.lower(F.regexp_replace(_as_column(c), NOISE_PATTERN, " "))
    long_words = F.regexp_replace(spaced, r"(?<!\S)\p{L}{1,2}(?!\S)", "")
    return F.trim(F.regexp_replace(long_words, r"\s+", " "))


def char_tokens(c: Column | str, mode: str = "alnum") -> Column:
    """The characters of a text, one space between them.

    ``all`` keeps every character but white space, ``alnum`` letters and digits of any script in
    lower case, ``ascii`` only a-z and 0-9 in lower case.
    """
    c = _as_column(c)
    kept = {
        "all": lambda: F.regexp_replace(c, WHITESPACE, ""),
        "alnum": lambda: F.regexp_replace(F.lower(c), WORD_GAP, ""),
        "ascii": lambda: F.regexp_replace(F.lower(c), NOT_ASCII_ALNUM, ""),
    }[mode]()
    return F.rtrim(F.regexp_replace(kept, "(.)", "$1 "))


def clone_tokens(c: Column | str, k: int) -> Column:
    return F.array_join(
        F.transform(split_tokens(c), lambda t: F.array_join(F.array_repeat(t, k), " ")), " "
    )


def clean_category_id(c: Column | str) -> Column:
    """``'1,234'`` to 1234."""
    return F.replace(_as_column(c), F.lit(","), F.lit("")).cast("bigint")


def prediction_label(flag: Column | str, category_id: Column | str) -> Column:
    """The category id, or ``not <id>`` for a negative prediction."""
    category = _as_column(category_id).cast("string")
    return F.when(_as_column(flag), category).otherwise(F.concat(F.lit("not "), category))


def path_parts(c: Column | str) -> Column:
    return F.split(_as_column(c), PATH_SEPARATOR)


def feature_words(c: Column | str) -> Column:
    """Lower-cased runs of at least two word characters, the tokens of count and TF-IDF features."""
    return F.regexp_extract_all(F.lower(_as_column(c)), F.lit(FEATURE_WORD), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.size(split_tokens(c))


# -- n-grams ---------------------------------------------------------------------------------


def char_ngrams(c: Column | str, lo: int, hi: int) -> Column:
    """Character n-grams of one word as an array, shorter ones first."""
    c = _as_column(c)
    return F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in range(lo, hi + 1)]),
            lambda n: _over_range(F.length(c) - n + 1, lambda i: F.substring(c, i, n)),
        )
    )


def char_ngrams_all(c: Column | str) -> Column:
    """Every substring of one word, shorter ones first."""
    c = _as_column(c)
    return F.flatten(
        _over_range(F.length(c), lambda n: _over_range(F.length(c) - n + 1, lambda i: F.substring(c, i, n)))
    )


def sentence_char_ngrams(c: Column | str) -> Column:
    """Every substring of every word of a text, word after word."""
    return F.flatten(F.transform(split_tokens(c), char_ngrams_all))


def token_ngrams(tokens: Column | str, lo: int, hi: int, sep: str = " ") -> Column:
    """n-grams over an array of tokens, longer ones first."""

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        if n == 2:
            others = F.greatest(F.size(t) - 1, F.lit(0))
            return F.zip_with(
                F.slice(t, F.lit(1), others), F.slice(t, F.lit(2), others), lambda a, b: F.concat(a, F.lit(sep), b)
            )
        return _over_range(F.size(t) - (n - 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), sep))

    return bind(_as_column(tokens), lambda t: F.concat(*[of_size(t, n) for n in range(hi, lo - 1, -1)]))


def word_ngrams(c: Column | str, lo: int, hi: int) -> Column:
    """n-grams over the lower-cased white-space tokens of a text, longer ones first."""
    return token_ngrams(tokens_ws(c), lo, hi)


def word_ngrams_all(c: Column | str) -> Column:
    """n-grams of every length over letter/digit tokens, longest first."""
    return bind(
        tokens_replace(c),
        lambda t: F.flatten(
            F.reverse(
                _over_range(
                    F.size(t),
                    lambda n: _over_range(F.size(t) - n + 1, lambda i: F.array_join(F.slice(t, i, n), " ")),
                )
            )
        ),
    )


def bigramize(c: Column | str) -> Column:
    """``aa bb cc`` to ``aa_bb bb_cc``; a text of one token gives the empty string."""
    return F.array_join(token_ngrams(split_tokens(c), 2, 2, "_"), " ")


def term_runs(tokens: Column | str) -> Column:
    """``[(token, n), ...]``: how often each token occurs in one array, in token order.

    Counting inside the row spares the shuffle that a grouped count per (row, token) would need.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        return bind(
            starts,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(s, i - 1).alias("token"),
                    (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("bigint").alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<token:string,n:bigint>>")
    return bind(F.sort_array(_as_column(tokens)), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def pair_structs(tokens: Column | str) -> Column:
    """All (earlier token, later token) pairs of one array."""
    return bind(
        _as_column(tokens),
        lambda t: F.flatten(
            _over_range(
                F.size(t) - 1,
                lambda i: F.transform(
                    F.slice(t, i + 1, F.size(t) - i),
                    lambda later: F.struct(F.element_at(t, i).alias("first"), later.alias("second")),
                ),
            )
        ),
    )


# -- fixed-length encodings ------------------------------------------------------------------


def pad_left(seq: Column | str, m: int) -> Column:
    """Zeros in front up to length ``m``; a longer sequence keeps its last ``m`` entries."""
    zeros = F.array_repeat(F.lit(0), m)
    return F.slice(F.concat(zeros, _as_column(seq)), -m, m)


def char_sequence(c: Column | str, m: int, alphabet: str = CHAR_ALPHABET) -> Column:
    """Alphabet positions from 1 of the characters of a text, 0 for others, padded on the left."""
    dense = F.regexp_replace(F.lower(_as_column(c)), WHITESPACE, "")
    last = F.when(F.length(dense) > m, F.substring(dense, -m, m)).otherwise(dense)
    chars = F.array_remove(F.split(last, ""), "")
    return pad_left(F.transform(chars, lambda ch: F.instr(F.lit(alphabet), ch)), m)


def one_hot(index: Column | str, n: int) -> Column:
    """Array of ``n`` zeros with a one at ``index`` (from 1); all zeros for index 0."""
    index = _as_column(index)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def bag_of_chars(c: Column | str, alphabet: str = CHAR_ALPHABET) -> Column:
    """How often each character of the alphabet occurs in a text."""
    return bind(
        F.lower(_as_column(c)),
        lambda t: F.transform(
            F.array(*[F.lit(ch) for ch in alphabet]), lambda ch: F.length(t) - F.length(F.replace(t, ch, F.lit("")))
        ),
    )


def nested_ngrams(seq: Column | str, n: int, m: int) -> Column:
    """The first ``m`` n-grams of an id sequence as an ``m`` x ``n`` array filled up with zeros."""

    def rows(s: Column) -> Column:
        grams = _over_range(
            F.least(F.size(s) - (n - 1), F.lit(m)), lambda i: F.slice(s, i, F.lit(n))
        )
        empty = F.array_repeat(F.array_repeat(F.lit(0), n), m)
        return F.slice(F.concat(grams, empty), 1, m)

    return bind(_as_column(seq), rows)
