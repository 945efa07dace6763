"""Worked examples for the column functions."""

import pytest
from pyspark.sql import functions as F

from shelfsift.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column).first()[0]


CASES = [
    (lambda: tx.process_string(F.lit("AA bb c@c Df!")), "aa bb cc df"),
    (lambda: tx.process_string(F.lit("Wet/Dry  Vac, 2.5 gal")), "wetdry  vac 25 gal"),
    (lambda: tx.process_string(F.lit("Ünder\tline_~{}€😀 ok")), "nderline ok"),
    (lambda: tx.collapse_spaces(F.lit("a   b  c")), "a b c"),
    (lambda: tx.tokens_delete(F.lit("Red bolt")), ["ed", "bolt"]),
    (lambda: tx.tokens_replace(F.lit("a-b, été_1")), ["a", "b", "été", "1"]),
    (lambda: tx.tokens_ws(F.lit("  A b\n c ")), ["a", "b", "c"]),
    (lambda: tx.tokens_ws(F.lit("")), []),
    (lambda: tx.r_clean(F.lit("a 12 Big-Deal® of xy items")), "big deal items"),
    (lambda: tx.char_tokens(F.lit("!iT Jeans Maternity Skinny")), "i t j e a n s m a t e r n i t y s k i n n y"),
    (lambda: tx.char_tokens(F.lit("aé B"), "ascii"), "a b"),
    (lambda: tx.char_tokens(F.lit("a B!"), "all"), "a B !"),
    (lambda: tx.clone_tokens(F.lit("red bolt"), 2), "red red bolt bolt"),
    (lambda: tx.strip_spaces(F.lit(" a b ")), "ab"),
    (lambda: tx.clean_category_id(F.lit("1,234")), 1234),
    (lambda: tx.prediction_label(F.lit(True), F.lit(213)), "213"),
    (lambda: tx.prediction_label(F.lit(False), F.lit(213)), "not 213"),
    (lambda: tx.path_parts(F.lit("A > B > C")), ["A", "B", "C"]),
    (lambda: tx.char_ngrams(F.lit("abc"), 1, 3), ["a", "b", "c", "ab", "bc", "abc"]),
    (lambda: tx.char_ngrams_all(F.lit("abc")), ["a", "b", "c", "ab", "bc", "abc"]),
    (lambda: tx.sentence_char_ngrams(F.lit("ab c")), ["a", "b", "ab", "c"]),
    (lambda: tx.word_ngrams(F.lit("A b c"), 1, 2), ["a b", "b c", "a", "b", "c"]),
    (lambda: tx.word_ngrams(F.lit(""), 1, 3), []),
    (lambda: tx.word_ngrams(F.lit("a b c d"), 3, 3), ["a b c", "b c d"]),
    (lambda: tx.word_ngrams_all(F.lit("a-b c")), ["a b c", "a b", "b c", "a", "b", "c"]),
    (lambda: tx.bigramize(tx.process_string(F.lit("AA bb c@c Df!"))), "aa_bb bb_cc cc_df"),
    (lambda: tx.bigramize(F.lit("one")), ""),
    (lambda: tx.pad_left(F.array(F.lit(1), F.lit(2)), 5), [0, 0, 0, 1, 2]),
    (lambda: tx.pad_left(F.array(*map(F.lit, range(1, 7))), 5), [2, 3, 4, 5, 6]),
    (lambda: tx.char_sequence(F.lit("a 1 - z"), 4), [11, 2, 0, 36]),
    (lambda: tx.char_sequence(F.lit("ab"), 4), [0, 0, 11, 12]),
    (lambda: tx.one_hot(F.lit(2), 3), [0.0, 1.0, 0.0]),
    (lambda: tx.nested_ngrams(F.array(*map(F.lit, [1, 2, 3])), 2, 3), [[1, 2], [2, 3], [0, 0]]),
    (lambda: tx.pair_structs(F.split(F.lit("a b c"), " ")), [("a", "b"), ("a", "c"), ("b", "c")]),
    (lambda: tx.term_runs(F.split(F.lit("b a b"), " ")), [("a", 1), ("b", 2)]),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_example(spark, number):
    column, expected = CASES[number]
    got = value(spark, column())
    if isinstance(got, list):
        got = [tuple(g) if hasattr(g, "asDict") else g for g in got]
    assert got == expected


def test_null_text_gives_null(spark):
    nothing = F.lit(None).cast("string")
    for column in (tx.process_string(nothing), tx.tokens_ws(nothing), tx.bigramize(nothing), tx.r_clean(nothing)):
        assert value(spark, column) is None
