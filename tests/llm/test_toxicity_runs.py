"""Texts without spaces are read to their end."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from quire.llm import toxicity  # noqa: E402


def test_long_runs_are_read_whole():
    for run in ("漢字かな交じり文" * 30, "a" * 1000, "é" * 333, "x" + "😀" * 50):
        words = toxicity.words_of(run)
        assert b"".join(words) == run.encode() and max(map(len, words)) <= toxicity.LONGEST
        assert all(w.decode() for w in words)  # cut between characters


def test_the_end_of_a_long_run_changes_the_score():
    model = toxicity.Model(toxicity.new_params(1, np.random.default_rng(0)))
    head = "漢" * 60
    a, b = toxicity.Scorer(model).largest([head + "字" * 20, head + "悪" * 20])
    assert a != b
