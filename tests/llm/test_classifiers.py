import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import langid, toxicity


def clean_text(rng):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120)))


def toxic_text(rng):
    w = clean_text(rng).split()
    for _ in range(rng.randrange(1, 4)):
        w.insert(rng.randrange(len(w)), "vexhork" + rng.choice(["a", "ing", "ed", "s", "ton"]))
    return " ".join(w)


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(8)
    return [(i, toxic_text(rng) if i % 5 == 0 else clean_text(rng), int(i % 5 == 0)) for i in range(900)]


def test_toxicity_finds_unseen_spellings(spark, toxic_rows):
    extra = [(1000, "vexhorkly " + clean_text(random.Random(1)), None), (1001, None, None), (1002, "", None), (1003, "?!", None), (None, "so vexhorked it is", None), (0, "la la", None), (1004, "da " * 4000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in toxic_rows + extra], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows] + [(5, None), (6, 7), (None, 1), (99999, 1)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.classify(docs, labels, F.col("doc_id") % 3 != 1).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, got.values())) == len(toxic_rows) + len(extra) and all(0 <= s <= 1 for v in got.values() for s in v)
    held = [(got[i][0] >= 0.7, bool(y)) for i, _, y in toxic_rows if i % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    clean = [got[i][0] for i, _, y in toxic_rows if not y]
    assert got[1000][0] > np.quantile(clean, 0.99) and got[None][0] > np.quantile(clean, 0.99)
    assert max(got[1001] + got[1002] + got[1003]) < 0.1 and got[1004][0] < 0.7


def test_the_draw_is_filled_from_labels_that_have_a_document(spark, monkeypatch):
    """Labels without a document, and long texts, take no place from others."""
    docs = spark.createDataFrame([(i, ("word " * (4000 if i % 2 else 3))) for i in range(200)] + [(7, "again " * 3), (7, None)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic")
    got = toxicity.training_sample(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(200))
    assert sum(len(r["text"]) == 20_000 for r in got) in (99, 100)
    monkeypatch.setattr(toxicity, "MAX_TRAINING_ROWS", 40)
    got = toxicity.training_sample(docs, labels).collect()
    assert len(got) == 40 and sum(r["toxic"] for r in got) == 20
    monkeypatch.setattr(toxicity, "MAX_TRAINING_BYTES", 60_000)
    assert 3 <= len(toxicity.training_sample(docs, labels).collect()) < 20


def brute_score(model, text):
    """One character n-gram, word and window after the other, in plain loops."""
    values, mask = model.values().astype(float), 0xFFFFFFFF

    def word_value(w):
        chars, grams = [ord(c) for c in f"<{w}>"], []
        for i in range(len(chars)):
            h = 0
            for n, c in enumerate(chars[i : i + max(toxicity.ORDERS)], 1):
                h = ((h ^ c) * 0x01000193) & mask
                h ^= h >> 13
                if n in toxicity.ORDERS:
                    grams.append(h % toxicity.BUCKETS)
        whole = 0
        for i, c in enumerate(chars):
            whole += (((c * 2654435761) & mask) ^ ((c << 7) & mask)) * (((len(chars) - i) * 40503 + 1) & mask)
        whole &= mask
        grams.append((whole ^ (whole >> 16)) % toxicity.BUCKETS)
        return sum(values[g] for g in grams) / len(grams)

    said = []
    for w in toxicity.WORD.findall((text or "").lower()):
        if not said or said[-1] != w:
            said.append(w)
    if not said:
        logit = -30.0
    else:
        v = [word_value(w) for w in said]
        logit = max(sum(v[i : i + toxicity.WINDOW]) / len(v[i : i + toxicity.WINDOW]) for i in range(max(1, len(v) - toxicity.WINDOW + 1))) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_scores_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32), rng.normal(0, 1, toxicity.DIMENSIONS).astype(np.float32), 0.3)
    texts = [clean_text(random.Random(i)) for i in range(12)] + [None, "", "!?", "a", "the the the end", "Straße élan 漢字", toxic_text(random.Random(9)), "no " * 50]
    want = [brute_score(model, t) for t in texts]
    assert toxicity.Scorer(model).scores(texts) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 3)
    scorer = toxicity.Scorer(model)
    assert [float(scorer.scores([t])[0]) for t in texts] == pytest.approx(want, abs=1e-5)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in toxicity.classify(docs, labels, F.lit(True)).collect())
    assert toxicity.classify(docs.limit(0), labels, F.lit(True)).collect() == []


def test_passages_by_hand():
    v, begins = np.array([1.0, 3, -2, 5, 0, 0, 9, 1, 1]), np.array([0, 0, 2, 9])
    best, where = toxicity.passages(v, begins)
    means = [v[i : i + 6].mean() for i in range(2, 4)]
    assert best[0] == -np.inf and best[1] == 2.0 and best[2] == pytest.approx(max(means)) and where[2] == 2 + int(np.argmax(means))


def brute_posterior(model, text):
    logs = model.prior.copy()
    chars = np.array([ord(c) for c in (text or "").lower() + " "], np.uint32)
    for order in langid.ORDERS:
        for i in range(len(chars) - order + 1):
            logs += model.weights[langid._buckets(chars[i : i + order], order)[0]]
    p = np.exp(logs - logs.max())
    return p / p.sum()


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["the", "house", "with", "that"], "bb": ["über", "straße", "nicht", "haus"], "cc": ["señor", "niño", "que", "casa"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(500, None, "aa"), (501, "12 34 !", "aa"), (502, "", None), (503, "Nicht Haus", None), (None, "que casa", "cc"), (504, "that " * 9000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(3))
    train = F.col("doc_id") % 5 != 0
    got = {r["doc_id"]: r for r in langid.predict(docs, train).collect()}
    assert len(got) == len(rows)
    known = docs.where(train & F.col("lang").isNotNull()).select("text", "lang")
    model = langid.train(known, {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()})
    for i, text, lang in rows:
        if i in (500, 501, 502):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        elif i != 504:
            p = brute_posterior(model, text)
            assert got[i]["lang_pred"] == model.languages[p.argmax()] and got[i]["score"] == pytest.approx(p.max(), abs=1e-4)
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:300]) > 290
    assert [r["lang_pred"] for r in langid.predict(docs, F.lit(False)).limit(3).collect()] == ["und"] * 3
    assert langid.predict(docs.limit(0), train).collect() == []


def test_languages_in_blocks_and_fit(spark, monkeypatch):
    """Languages block by block give what they give at once; junk, mixtures and unknown languages fit badly."""
    rng = random.Random(5)
    tongues = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(40)] for k in range(7)}
    say = lambda k, n: " ".join(rng.choice(tongues[k]) for _ in range(n))
    rows = [(i, say(k, rng.randrange(5, 60)), k) for i in range(350) for k in [f"l{i % 7:02}"]]
    plain = [(1000 + i, say("l03", 40), None) for i in range(20)]
    junk = [(2000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(300)), None) for i in range(20)]
    mixed = [(3000 + i, say("l01", 30) + " " + say("l02", 30), None) for i in range(20)]
    other = [(4000 + i, " ".join(rng.choice(["добрый", "вечер", "сегодня", "погода"]) for _ in range(40)), None) for i in range(20)]
    docs = spark.createDataFrame(rows + plain + junk + mixed + other + [(5000, None, None), (5001, "7 !", "l01")], "doc_id long, text string, lang string").withColumns({"best": F.lit("x"), "fit": F.lit(0)})
    find = lambda: {r["doc_id"]: r for r in langid.predict(docs, F.lit(True), fit_col="fit").collect()}
    whole = find()
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 3)
    parts = find()
    for i, r in whole.items():
        assert (r["lang_pred"], r["best"]) == (parts[i]["lang_pred"], "x") and r["score"] == pytest.approx(parts[i]["score"], abs=1e-9)
    fits = lambda group: [whole[r[0]]["fit"] for r in group]
    assert min(fits(plain)) > 0.5 and max(fits(other)) < 0.3
    assert sum(f < 0.3 for f in fits(junk)) >= 18 and sum(f < 0.3 for f in fits(mixed)) >= 18
    assert whole[5000]["fit"] == whole[5001]["fit"] == 0
