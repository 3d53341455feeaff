import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    return [w.lower() if w.isascii() else w for w in WORD.findall(text or "")] + ["\n"]


def test_base_counts_and_proper_probabilities(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 6)  # so that most counts come by the join
    rows = [(i, ("the cat the dog " if i % 2 else "le chat le chien ") * (i % 4) + f"w{i % 7} W{i % 3}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen words"), (None, "the cat"), (3, "the cat"), (103, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    train = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in toks(t))
    total, distinct = sum(c.values()), len(c)
    got = hmm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(toks(t)), sum(w in c for w in toks(t)), round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in toks(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_forward_is_exact():
    model = hmm.first_model(9)
    symbols, begins = np.array([1, 2, 8, 0, 3, 3], np.uint16), np.array([0, 4, 5, 6])
    got = hmm.log_likelihoods(model, symbols, begins)
    for d in range(3):
        seq = symbols[begins[d] : begins[d + 1]]
        p = model.start * model.emit[seq[0]]
        for s in seq[1:]:
            p = (p @ model.move) * model.emit[s]
        assert got[d] == pytest.approx(math.log10(p.sum()))


def test_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    model = hmm.first_model(4)
    seq = rng.integers(0, 4, 4).astype(np.uint16)
    counts = hmm.no_counts(4)
    hmm.expected_counts(model, seq, np.array([0, 4]), counts)
    paths = np.array(np.meshgrid(*[range(hmm.STATES)] * 4)).reshape(4, -1)
    p = model.start[paths[0]] * model.emit[seq[0], paths[0]]
    for t in range(1, 4):
        p = p * model.move[paths[t - 1], paths[t]] * model.emit[seq[t], paths[t]]
    p /= p.sum()
    move = np.zeros((hmm.STATES,) * 2)
    for t in range(3):
        np.add.at(move, (paths[t], paths[t + 1]), p)
    assert np.allclose(counts[1], move, atol=1e-4)
    assert counts[0].sum() == pytest.approx(1, abs=1e-4) and counts[2].sum() == pytest.approx(4, abs=1e-3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(docs, F.lit(True)).collect() == []


def brute_train(texts, n_symbols):
    """Baum-Welch in plain float64, one text and one token after the other."""
    model, likelihoods = hmm.first_model(n_symbols), []
    for _ in range(hmm.ITERATIONS):
        start, move, emit, total = np.full(hmm.STATES, hmm.MASS), np.full((hmm.STATES,) * 2, hmm.MASS), np.full((n_symbols, hmm.STATES), hmm.MASS), 0.0
        for seq in texts:
            alpha, scale = [], []
            for t, s in enumerate(seq):
                x = (model.start if t == 0 else alpha[-1] @ model.move) * model.emit[s]
                scale.append(x.sum())
                alpha.append(x / x.sum())
            total += np.log10(scale).sum()
            beta = np.ones(hmm.STATES)
            for t in range(len(seq) - 1, -1, -1):
                emit[seq[t]] += alpha[t] * beta
                if t == 0:
                    start += alpha[0] * beta
                else:
                    ahead = model.emit[seq[t]] * beta / scale[t]
                    move += model.move * np.outer(alpha[t - 1], ahead)
                    beta = model.move @ ahead
        likelihoods.append(total)
        model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, likelihoods


@pytest.mark.parametrize("known", [6, 1 << 18])
def test_scores_against_plain_loops(spark, monkeypatch, known):
    """The whole of ``score``: symbols, training over long texts, forward recursion and the words' shares."""
    from shelfmark.llm import words

    monkeypatch.setattr(hmm, "KNOWN_WORDS", known)
    monkeypatch.setattr(hmm, "FREQUENT_WORDS", 5)
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 500)
    rows = [(i, ("the cat sees the dog " if i % 2 else "le chat voit le chien ") * (i % 5 + 1) + f"w{i % 9}") for i in range(40)]
    rows += [(50, "one long text " * 1500), (51, None), (52, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in hmm.score(docs, F.col("doc_id") % 7 != 2).collect()}
    train = [toks(t) for i, t in rows if i % 7 != 2]
    c = Counter(w for t in train for w in t)

    def hashed(w):
        import pyarrow as pa

        return int(hmm.END) if w == "\n" else int(words.word_hashes(*words.utf8(pa.array([w])))[0][0])

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h = {w: hashed(w) for t in [toks(t) for _, t in rows] for w in t}
    top = sorted(c, key=lambda w: (-c[w], signed(h[w])))
    if len(c) > known:  # those with a count that no more words than that reach
        top = [w for w in top if sum(c[v] >= c[w] for v in c) <= known]
    own = {w: k for k, w in enumerate(top[: hmm.FREQUENT_WORDS])}
    symbol = lambda w: own.get(w, len(own) + h[w] % hmm.RARE_SYMBOLS)
    mass = Counter()
    for w in c:
        mass[symbol(w)] += c[w] + 1
    model, likelihoods = brute_train([[symbol(w) for w in t] for t in train], len(own) + hmm.RARE_SYMBOLS)
    assert all(b > a for a, b in zip(likelihoods, likelihoods[1:], strict=False))  # each iteration makes the texts likelier
    for i, text in rows:
        want, alpha = 0.0, None
        for w in toks(text):
            x = (model.start if alpha is None else alpha @ model.move) * model.emit[symbol(w)]
            want += math.log10(x.sum())
            alpha = x / x.sum()
            if w not in own:
                want += math.log10((c[w] + 1) / (mass[symbol(w)] + 1))
        assert got[i] == pytest.approx(want, rel=2e-4)


def test_count_of_rank(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BINS", 5)
    c = [1, 1, 1, 2, 2, 7, 7, 7, 30, 500]
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(c)], "word long, c long")
    for rank in (1, 2, 4, 5, 6, 7, 9, 10, 100):
        least = hmm.count_of_rank(counts, max(c), rank)
        assert least == min(k for k in range(1, 600) if sum(x >= k for x in c) <= rank)
