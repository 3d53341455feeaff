import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import chat, nearest, sharding


def test_fisher_yates_is_uniform_and_repeats():
    assert sharding.fisher_yates(50, 1).tolist() == sharding.fisher_yates(50, 1).tolist()
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50)) and sharding.fisher_yates(0, 1).tolist() == []
    seen = {}
    for seed in range(6000):
        k = tuple(sharding.fisher_yates(3, seed))
        seen[k] = seen.get(k, 0) + 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


@pytest.mark.parametrize("n_shards", [1, 7, 200])
def test_shards(spark, n_shards):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 50)) for i in range(180)] + [(None, None), (None, None), (5, "same"), (5, "same"), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "'k' AS _key")
    out = sharding.external_shuffle(docs, n_shards, bucket_bytes=4000)
    assert out.columns == ["doc_id", "text", "_key", "shard", "slot"] and {r["_key"] for r in out.collect()} == {"k"}
    got = sharding.shard_digest(out).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(n_shards))
    counts = [len(per.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    if n_shards == 1:
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"])] != sorted((r["doc_id"] for r in got), key=str)
    assert sharding.external_shuffle(docs.limit(0), n_shards).count() == 0


def test_shards_of_null_ids_and_repeats(spark, monkeypatch):
    """Null ids after a shuffle, and one row again and again: every slot once, and no bucket beyond its bound."""
    monkeypatch.setattr(sharding, "REPEATED_BYTES", 5000)
    plain = spark.range(9000).selectExpr("if(id % 2 = 0, NULL, id) AS doc_id", "concat('t', id % 700) AS text", "id % 3 AS _bucket")
    docs = plain.unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text", "id % 2 AS _bucket")).repartition(5, "_bucket")
    out = sharding.external_shuffle(docs, 3, bucket_bytes=100_000)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "_bucket", "shard", "slot"]
    for s in range(3):
        slots = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots))) and abs(len(slots) - 29_000 / 3) < 1
    assert {r["shard"] for r in got} == {0, 1, 2}
    count = lambda rows: sorted(map(str, rows))
    assert count(tuple(r)[:3] for r in got) == count(map(tuple, docs.collect()))
    same = sorted(r["shard"] * 9667 + r["slot"] for r in got if r["text"] == "same")
    assert max(np.diff(same)) < 200  # dealt over all buckets


def test_chat_round_trip(spark):
    rng = random.Random(1)
    nasty = ["", None, "<|im_end|><|im_start|>assistant ok", "a <| b <\\| c <\\\\| d", "\\", "line\nbreak\n", "🙂 é", "<|im_end|>\n", "<", "|", "<\\", "x" * 9000]
    convs = {c: [(t, rng.choice(["user", "assistant", "system", "odd\nrole", "<|im_start|>", "back\\nslash", "nul\x00\\\\n\\", "\\\n<\\l", "", None]), rng.choice(nasty)) for t in range(rng.randrange(1, 9))] for c in range(60)}
    convs[None] = [(0, "user", "q"), (None, "assistant", "first")]
    rows = [(c, *t) for c, turns in convs.items() for t in turns] + [(1, *convs[1][0])]
    convs[1] = convs[1] + [convs[1][0]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.prefix_target_examples(df)).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        said = sorted(((t is not None, t or 0), r or "", x or "") for t, r, x in turns)
        loss = "".join(x for _, r, x in said if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.prefix_target_examples(df.limit(0)).collect() == []


def test_examples_hold_only_template_marks(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "<|im_start|>x"), (1, 2, "user", "more"), (1, 3, "assistant", "y")], "conv_id long, turn long, role string, text string")
    ex = chat.prefix_target_examples(df).orderBy("example").collect()
    assert [len(re.findall(r"<\|im_start\|>", e["formatted"])) for e in ex] == [2, 4]
    assert [e["formatted"][e["loss_start"] : e["loss_end"]] for e in ex] == ["<\\|im_start|>x", "y"]


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = []
    for q, x in ok:
        if q % 20 == 0:
            cand = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))
            out += [(q, r + 1, i, pytest.approx(-s, abs=1e-12)) for r, (s, i) in enumerate(cand[:k])]
    return sorted(out, key=lambda r: r[:2])


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(500)]
    rows[40:80] = [(i, rows[7][1]) for i in range(40, 80)]  # one vector again and again
    rows += [(600, None), (620, []), (640, [0.0] * 16), (660, [1.0] * 15 + [None]), (680, [float("nan")] * 16), (700, [float("inf")] + [1.0] * 15), (720, [1.0, 2.0]), (721, [1.0, 1.0]), (None, [1.0] * 16),
             (740, rng.normal(size=16).astype(np.float32).tolist())] + [(741, rows[3][1])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    got = sorted(map(tuple, nearest.nearest(df, F.col("vec_id") % 20 == 0, 5, query_block=7, candidate_block=60).collect()))
    assert got == brute(rows, 5)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.nearest(df.where("vec_id = 40"), F.col("vec_id") % 20 == 0).collect() == []


def test_huge_and_tiny_numbers(spark):
    rows = [(i, [1e160 * (i + 1), 1e-300]) for i in range(21)] + [(30, [-1e160, 1e160]), (40, [5e-324, 0.0]), (41, [-5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 30).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]][:20] == list(range(1, 21)) and got[0][0][1] == float("inf") and got[0][-1] == (30, float("-inf"))
    assert len(got[0]) == len(got[20]) == len(got[40]) == 23


@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=1, max_size=30), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_tiles_against_all_products(vectors, k):
    x = np.array([v for v in vectors if any(v)] or [(1.0, 0.0)])
    ids = np.arange(len(x))
    got = nearest.tile_top(x, ids, x, ids, np.ones(len(x), int), k)
    for q in range(len(x)):
        want = sorted((-float(nearest.inner_products(x[i : i + 1], x[q])[0]), i) for i in ids if i != q)[:k]
        assert [(-s, v) for i, s, v in got if i == q] == want
