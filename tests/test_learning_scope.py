"""What the model queries ask for, without fitting anything."""

import inspect
from unittest.mock import MagicMock

import pytest

from shelfsift.queries import learning


@pytest.mark.parametrize("name, fit, iters", [("neural_net", "fit_mlp", 15), ("merged_word_and_pair_model", "fit_lr", 50), ("count_and_tfidf_model", "fit_lr", 50)])
def test_iterations(monkeypatch, name, fit, iters):
    signature, asked = inspect.signature(getattr(learning.ln, fit)), []

    def fitted(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        asked.append(bound.arguments["iters"])

    for helper in ("_vectors", "_judged", "_scored", "stage"):
        monkeypatch.setattr(learning, helper, MagicMock())
    for features in ("merged_features", "count_and_tfidf"):
        monkeypatch.setattr(learning.ln, features, MagicMock())
    monkeypatch.setattr(learning.ln, fit, fitted)
    inspect.unwrap(getattr(learning, name))(None, "")
    assert asked == [iters]
