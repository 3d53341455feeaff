"""The operators on n-gram weights, licence notices and fill-in-the-middle, against plain Python."""

import difflib
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fim, licenses, registry, resampling, wordcols

LONG = " ".join(f"word{i % 977} Released under the MIT License." if i % 500 == 0 else f"w{i % 311}" for i in range(60_000))
TEXTS = [
    None, "", "   ", "...", "one", "ÉCOLE École 東京 x", "Under the MIT License", "under the mit license under the MIT licence; cc by-nc, CC BY NC 4.0!", "Apache License, Version 2.0",
    "a<b <P> marked", "tail spaces  \n", "\t lead", "word " * 30, "word " * 30, LONG, "released by us under the mit license today", "<", "x<S", "P> S> M>",
    "This work is licensed under the GNU General Public License, version 3.", "This work is now licensed under the GNU General Public License version 3",
    "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and the associated documentation files, to deal in the Software without restriction",
    *(f"common words of row {i} with some more of them so that there are twenty or so in this text {i % 7} {i % 3} and more" for i in range(60))]


def table(spark, texts=TEXTS, more=True):
    rows = [(None if i == 3 else i // 2 if i > 70 else i, t, "x", 1, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int, n_words string")
    return df if more else df.select("doc_id", "text")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def as_id(i):
    return "" if i is None else str(i)


def numbers(text):
    h = hashlib.sha256(text.encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_equals_plain_python(spark, order):
    docs = table(spark)
    target = ["common words and more", None, "", "twenty of them", "École x"]
    runs = lambda t: [" ".join(w[i : i + n]) for w in [plain_words(t)] for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    bucket = lambda run: zlib.crc32(run.encode()) % 500
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    s, t = (Counter(bucket(run) for x in texts for run in runs(x)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (sum(s.values()) + 500)) / ((s[b] + 1) * (sum(t.values()) + 500))))
    want, able = [], []
    for i, x in rows:
        weight = sum(gain(bucket(run)) for run in runs(x))
        score = weight + math.floor(-1000 * math.log(-math.log((numbers(f"7:{as_id(i)}")[0] + 0.5) / 4294967296)))
        want.append([i, len(runs(x)), weight, score, None])
        if len(plain_words(x)) >= 20:
            able.append(want[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=25, max_order=order, buckets=500, seed=7)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    key = lambda r: tuple((x is None, x) for x in r)
    # of rows that are equal in all but the rank, any may be the drawn one
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_resampling_without_rows(spark):
    docs, none = table(spark, TEXTS[:20], more=False), table(spark, [])
    assert resampling.resample(none, docs).count() == 0
    assert {r["rank"] for r in resampling.resample(docs, none, percent=100).collect()} == {None, 1, 2, 3}
    assert {r["weight"] for r in resampling.resample(table(spark, [None, "", "."]), none).collect()} == {0}


def test_ranks_are_gapless_over_many_partitions(spark):
    docs = spark.range(3000).select((F.col("id") % 10).alias("doc_id"), F.lit("the same twenty words " * 6).alias("text"))
    ranks = [r["rank"] for r in resampling.resample(docs, docs.limit(3), percent=50).where("rank IS NOT NULL").collect()]
    assert sorted(ranks) == list(range(1, 1501))


def brute_scan(text, phrases):
    """Places and labels of phrases in a text, by comparing every place."""
    w = plain_words(text)
    places = [(i, label) for label, p in phrases for q in [plain_words(p)] if q for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("phrases", [registry.PHRASES, [("x", "x"), ("two", "under the"), *registry.PHRASES, ("none", "?!")]])
def test_base_places_equal_every_place_compared(spark, phrases):
    docs = table(spark)
    got = licenses.scan(docs, phrases).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    want = [(r["doc_id"], *brute_scan(r["text"], phrases)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_notices(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, TEXTS[:22], more=False), registry.PHRASES).collect()}
    assert rows[19]["labels"] == "gpl-3" and rows[19]["base_labels"] == "" and rows[19]["score"] == 1.0
    assert rows[20]["labels"] == "gpl-3" and 0.8 <= rows[20]["score"] < 1  # a word put in, on two diagonals
    assert rows[21]["labels"] == "mit" and rows[21]["base_labels"] == ""
    assert rows[15]["labels"] == "mit" and rows[8]["labels"] == "apache-2" and rows[7]["base_labels"] == "cc-by-nc,mit"
    assert all(rows[i]["labels"] == "" and rows[i]["score"] == 0 for i in (0, 1, 2, 4, 5, 12))
    assert licenses.scan(table(spark, []), registry.PHRASES).count() == 0


def test_spans_hold_what_they_say(spark):
    """Each span of a notice, cut out of the text, is alike to the notice by a measure of its own."""
    docs = table(spark, TEXTS[:22], more=False).where("doc_id = 21 OR doc_id = 20")
    templates = licenses._templates([], licenses.NOTICES, 3)
    found = licenses.spans(licenses.votes(docs, templates), templates).where("share >= 0.7 AND best").join(
        licenses.votes(docs, templates).select("_row", "_id").distinct(), "_row").collect()
    assert found
    for r in found:
        words = plain_words(TEXTS[r["_id"]])[r["begin"] : r["end"]]
        assert difflib.SequenceMatcher(None, words, templates[r["template"]][3], autojunk=False).ratio() > 0.8


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h, n = numbers(f"42:{as_id(i)}"), len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return i, n, form, len(prefix), len(middle), sha(out), sha(text)


def test_fim_equals_plain_python(spark):
    docs = table(spark)
    made = fim.transform(docs.withColumn("form", F.lit("theirs")))
    assert made.columns[: len(docs.columns) + 1] == [*docs.columns, "form"] and "form_" in made.columns
    got = fim.digest(fim.transform(docs.drop("n_words"))).collect()
    want = [plain_fim(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fim.digest(fim.transform(table(spark, [], more=False))).count() == 0


def test_fim_shuffles_texts_once(spark):
    made = fim.digest(fim.transform(table(spark, more=False)))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(_row") - plan.count("ReusedExchange") <= 1 and "ReusedExchange" in plan


def test_words_of_columns(spark):
    texts = [t for t in TEXTS if t != LONG] + ["A-B_c'd 1a b", "\x00\x7f{", "ÀÉ İ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r["w"] for r in df.orderBy("i").select(wordcols.words(F.col("text")).alias("w")).collect()] == [plain_words(t) for t in texts]
