import random
import re

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import jaccard, skew, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    """(doc_id, n, component) by comparing all pairs of texts."""
    sets = []
    for i, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                group[root(a)] = root(b)
    smallest = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            smallest[root(a)] = min(smallest.get(root(a), i), i)
    return sorted(((i, len(s), smallest.get(root(a))) for a, (i, s) in enumerate(sets)), key=str)


def got(spark, rows, **params):
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **params).collect()
    return sorted((tuple(r) for r in out), key=str)


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "A B C D E"), (7, "a b c d e"),
            (8, "x " * 5000), (None, "a b c d e"), (9, "É a b"), (10, "é a b"), (None, "only here now"), (7, "another text under seven")]
    assert got(spark, rows, k=3, percent=90) == brute(rows, 3, 90)
    assert got(spark, [], k=3, percent=90) == []


def test_random_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 12)  # so that large groups are cut into blocks
    rng = random.Random(5)
    for k, percent in ((3, 90), (5, 80)):
        rows, vocab = [], [f"w{i}" for i in range(60)]
        for family in range(6):
            base = [rng.choice(vocab) for _ in range(rng.randrange(30, 160))]
            for _ in range(60 if family == 0 else rng.randrange(1, 12)):
                text = list(base)
                for _ in range(rng.randrange(0, 4)):
                    text[rng.randrange(len(text))] = rng.choice(vocab)
                rows.append((len(rows), " ".join(text)))
        assert got(spark, rows, k=k, percent=percent) == brute(rows, k, percent)


def test_block_links_against_all_pairs():
    """Parts that the links join, with and without labels joined before, for blocks against themselves and others."""
    rng = np.random.default_rng(3)
    for percent in (50, 80, 100):
        sets = []
        for _ in range(60):
            base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 400, rng.integers(1, 40)).astype(np.uint64)
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.concatenate([keep if len(keep) else base, rng.integers(0, 400, rng.integers(0, 3)).astype(np.uint64)])))
        label = np.where(rng.random(60) < 0.3, rng.integers(0, 5, 60), 100 + np.arange(60))
        for left, right in ((np.arange(60), np.arange(60)), (np.arange(20), np.arange(20, 60))):
            def parts(links, label=label):
                now = label.copy()
                for i, j in links:
                    now[now == now[j]] = now[i]
                return [now.tolist().index(x) for x in now]

            pairs = [(i, j) for i in left for j in right if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
            found = jaccard._block_links(sets, left, right, label, percent)
            assert parts(found) == parts(pairs) and set(found) <= {(int(i), int(j)) for i, j in pairs} | {(int(j), int(i)) for i, j in pairs}


def test_bands_and_hot_keys(spark, monkeypatch):
    """Bands of sizes that can link are neighbours; a join on counted keys gives what a plain one gives, hot keys or not."""
    n = spark.range(1, 3000).select(F.col("id").alias("n"))
    for percent in (50, 80, 90, 100):
        band = {r["n"]: r["band"] for r in n.withColumn("band", jaccard.band_of(F.col("n"), percent)).collect()}
        assert all(abs(band[x] - band[min(2999, x * 100 // percent)]) <= 1 for x in band)
    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id % 50) AS k", "id AS v").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) k, 5L v"))
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 4").withColumn("w", F.col("k") * 2)
    got = skew.join_counted(rows, side, ["k"], "n")
    assert got.columns == ["k", "v", "w"] and sorted(got.collect()) == sorted(rows.join(side.drop("n"), "k").collect())


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["A b  c", None, "", "a B\nc", "é x"]
    seen = []
    for _, _, data, offsets in words.chunks(pa.array(texts), 4):
        h, begins = words.word_hashes(data, offsets)
        seen += [h[begins[i] : begins[i + 1]].tolist() for i in range(len(begins) - 1)]
    assert seen[0] == seen[3] and [len(x) for x in seen] == [3, 0, 0, 3, 1]


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (7, "g h i j k"), (7, "l m n o p"), (7, "g h i j k"), (3, None), (4, ""), (None, "g h i j k"), (None, "q r s t u"), (None, "q r s t u"), (9, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS component_id", "doc_id AS id", "'z' AS hash")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (7, "g h i j k"), (7, "l m n o p"), (3, None), (4, ""), (None, "q r s t u"), (9, "x y")], key=str)
