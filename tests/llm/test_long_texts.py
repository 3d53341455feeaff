"""What is done piece by piece for a long text gives what it gives in one go."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import decontamination, hmm, langid


def test_language_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    weights = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3)).T.astype(np.float32).copy()
    model = langid.Model(["a", "b", "c"], np.log(np.full(3, 1 / 3)), weights, np.ones(3), np.ones(3))
    texts = pa.array(["ab", "", "some words of a text " * 4, None, "é", "more of it"])
    whole = langid.log_scores(model, texts)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 8)
    assert all(np.allclose(x, y) for x, y in zip(langid.log_scores(model, texts), whole, strict=True))


def test_training_in_stretches(monkeypatch):
    """States are carried over the borders of stretches: what is kept is bounded, the counts are those of the whole."""
    rng = np.random.default_rng(2)
    model, begins = hmm.first_model(50), np.array([0, 700, 701, 900, 1000])
    symbols = rng.integers(0, 50, 1000).astype(np.uint16)
    whole = hmm.no_counts(50)
    hmm.expected_counts(model, symbols, begins, whole)
    assert whole[2].sum() == pytest.approx(1000, rel=1e-4) and whole[1].sum() == pytest.approx(996, rel=1e-4)
    assert whole[3][0] == pytest.approx(hmm.log_likelihoods(model, symbols, begins).sum(), rel=1e-5)
    for tokens in (1, 64, 333):
        monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", tokens)
        parts = hmm.no_counts(50)
        hmm.expected_counts(model, symbols, begins, parts)
        assert all(np.allclose(x, y, rtol=1e-4, atol=1e-4) for x, y in zip(whole, parts, strict=True))


def test_leaks_in_stretches(monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    items = [word(40), word(25), word(60)]
    near = items[1].copy()
    near[24] = "other"
    text = " ".join(word(300) + items[0] + word(50) + near + word(200) + items[2] + items[0])
    known = decontamination.Items.of([1, 2, 3], [" ".join(x) for x in items])
    column = pa.array([text, " ".join(items[2]), " ".join(items[1][:24]), "", None])
    whole = list(decontamination._documents_that_leak(known, column))
    assert [i for i, _ in whole] == [0, 1, 2] and set(whole[0][1]) == {1, 2, 3}
    for stretch in (7, 50):
        monkeypatch.setattr(decontamination, "WINDOWS_AT_ONCE", stretch)
        assert list(decontamination._documents_that_leak(known, column)) == whole
