"""The pipeline's stages, each against a brute-force version of its decision on what the stage before kept."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import bpe, langid, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRANGE = {4000 + 100 * j + i for j in range(3) for i in range(20)}


def speak(rng, lang, n):
    syllables = {"aa": "ba de li mo nu ra si to".split(), "bb": "schö üb zu ent ge ver ung lich".split()}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(6), str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(700):
        lang = rng.choice(["aa", "bb"])
        text = speak(rng, lang, rng.randrange(20, 90))
        toxic = i % 6 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "grobhorst" + rng.choice(["en", "a", "ig"]))
            text = " ".join(w)
        docs.append((i, text, lang))
        labels.append((i, int(toxic)))
    items = [(k, speak(rng, "aa", 25)) for k in range(5)]
    docs += [(1000 + j, docs[j * 6 + 1][1] + (" extra" if j % 2 else ""), "aa") for j in range(20)]  # copies, near and exact
    docs += [(2000 + k, speak(rng, "aa", 30) + " " + t.upper() + ". " + speak(rng, "aa", 10), "aa") for k, t in items]
    docs += [(3000, None, None), (3001, "", "aa"), (3002, "123 456 !!", "bb"), (3003, speak(rng, "aa", 30_000), "aa"), (None, speak(rng, "bb", 40), "bb")]
    docs += [(4000 + i, "".join(rng.choice("bcdfghjkpqrstvwxyz      ") for _ in range(400)), None) for i in range(20)]  # letters without sense
    docs += [(4100 + i, " ".join(rng.choice(["добрый", "вечер", "погода", "сегодня", "улица"]) for _ in range(50)), None) for i in range(20)]  # no language of the corpus
    docs += [(4200 + i, speak(rng, "aa", 50) + " " + speak(rng, "bb", 35), None) for i in range(20)]  # two languages
    docs += [docs[1], docs[1]]  # one row three times
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {c: F.lit("x") for c in ("score", "component_id", "_language", "_fit", "_likelihood", "_toxicity", "_id", "_hash")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def sets(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, corpus, tmp_path):
    folder, docs, items = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, kept = df.columns, {d[0]: d[1] for d in docs}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, df, folder).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert df.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in df.collect()}
        assert kept[name].items() <= before.items()
        gone = before.keys() - kept[name].keys()
        if name == "toxicity":
            toxic = {i for i in range(0, 700, 6)}
            assert len(gone - toxic - STRANGE) <= 2 and len(toxic - gone) <= 3
        elif name == "language":
            assert {3000, 3001, 3002} <= gone <= {3000, 3001, 3002} | STRANGE and len(STRANGE - kept[name].keys()) >= 54
        elif name == "near_duplicates":
            ids = sorted(before, key=lambda i: (i is None, i))
            s, group = {i: sets(before[i]) for i in ids}, {i: i for i in ids}

            def root(x, group=group):
                while group[x] != x:
                    x = group[x]
                return x

            for n, a in enumerate(ids):
                for b in ids[:n]:
                    if len(s[a] & s[b]) * 100 >= 80 * len(s[a] | s[b]) > 0:
                        group[max(root(a), root(b))] = min(root(a), root(b))
            assert df.where("doc_id = 1").count() == 1
            assert gone == {i for i in ids if root(i) != i} and len(gone) >= 15
        else:
            assert gone == {2000 + k for k, _ in items} & before.keys()
        before = kept[name]
    out = corpus_pipeline.STAGES[-1][1](spark, df, folder)
    want = packing.token_pieces(df, bpe.tokenizer_path(), 1024).collect()
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_language_judges_texts_of_any_length_by_one_rule(spark):
    """A few plain words beside numbers, an address or a licence's line stay; senseless letters and other alphabets go, however short."""
    rng = random.Random(9)
    beside = ["+1 (269) 555-3296 4524132264652876", "someone.22@mail.example.com", "Released under the MIT License.", ""]
    rows = [(i, speak(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    short = [(1000 + i, speak(rng, "ab"[i % 2] * 2, 5) + " " + beside[i % 4], None) for i in range(80)]
    lengths = (40, 80, 120, 200, 300)
    junk = [(2000 + 100 * j + i, "".join(rng.choice("bcdfghjkpqrstvwxyz      ") for _ in range(n)), None) for j, n in enumerate(lengths) for i in range(20)]
    foreign = [(3000 + 100 * j + i, " ".join(rng.choice("добрый вечер погода сегодня улица красивый".split()) for _ in range(n))[:n], None) for j, n in enumerate(lengths) for i in range(20)]
    coded = [(4000 + i, "aGVs" + "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(40)) + "7", None) for i in range(20)]
    docs = spark.createDataFrame(rows + short + junk + foreign + coded, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert {d[0] for d in rows + short} <= kept
    for strange in (junk, foreign):
        for j in range(len(lengths)):
            assert len(kept & {d[0] for d in strange[20 * j : 20 * j + 20]}) <= 2
    assert not kept & {d[0] for d in coded}


def test_masking_long_runs_takes_no_time():
    for text in ("x" * 2_000_000, "ab:/" * 500_000, "www" * 500_000):
        assert re.sub(langid.NOT_PROSE, " ", text) == text
    assert re.sub(langid.NOT_PROSE, "#", "a b3 c@d http://e www.f.g h 5") == "a # # # # h #"


def test_run_and_empty(spark, corpus, tmp_path):
    folder, _, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 400
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
