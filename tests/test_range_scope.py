"""What the range search asks for, without fitting anything."""

import inspect
from unittest.mock import MagicMock

from shelfsift.queries import learning


def test_range_search_tries_all_learners_over_their_ranges(spark, monkeypatch):
    """it tried Naive Bayes alone, with two of its six smoothings."""
    asked = []
    signature = inspect.signature(learning.ln.search_ranges)

    def searched(*args, **how):
        bound = signature.bind(*args, **how)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return MagicMock(params={"ngram_range": (1, 1)}, score=0.0)

    monkeypatch.setattr(learning, "_judged", MagicMock())
    monkeypatch.setattr(learning.ln, "search_ranges", searched)
    inspect.unwrap(learning.range_search)(MagicMock(), "")
    how, = asked
    assert how["learners"] is learning.ln.default_learners and len(how["learners"](10)) == 7
    assert how["ranges"] == ((1, 1), (1, 2), (2, 2)) and how["max_features"] == (None,) and "draws" not in how["how"]
