import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import decontamination as d

WORD = re.compile(r"[^\W_]+")


def bag(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """(doc_id, item_id, best similarity) over every window of each item's size."""
    out = []
    for doc_id, text in docs:
        w, best = WORD.findall((text or "").lower()), {}
        for item_id, item in items:
            m = WORD.findall((item or "").lower())
            k = min(5, len(m))
            if not m or item_id is None or len(w) < k:
                continue
            width = min(len(m), len(w))
            for a in range(len(w) - width + 1):
                x, y = bag(w[a : a + width], k), bag(m, k)
                low = (x & y).total()
                sim = low / (x.total() + y.total() - low)
                if sim >= 0.8:
                    best[item_id] = max(best.get(item_id, 0), sim)
        out += [(doc_id, k, round(v, 9)) for k, v in best.items()]
    return sorted(out, key=str)


def test_against_all_windows(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(12, 40))) + ".") for i in range(25)] + [(90, "too Short item"), (92, "short, item"), (93, "w7 w8"), (94, "?!"), (91, None), (None, "a null id has no part in it"), (3, "another text that has the same id three")]
    docs = []
    for i in range(120):
        w = say(rng.randrange(5, 150))
        if i % 3 == 0:
            item = WORD.findall(items[rng.randrange(25)][1])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                item[rng.randrange(len(item))] = "edited"
            cut = rng.choice([0, 0, 1, 2, len(item) // 2])
            at = rng.randrange(len(w))
            w[at:at] = item[cut:]
        docs.append((i, ("; " if i % 2 else " ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "too short item"), (None, items[4][1]), (7, items[5][1]), (7, items[5][1]), (503, (items[6][1] + " ") * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in d.leaks(df, bench).collect()), key=str)
    assert got == brute(docs, items) and len(got) > 10
    bad = {g[0] for g in got} - {7}
    kept = d.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, t in docs if i not in bad and not (i == 7 and t == items[5][1]))
    assert d.leaks(df.limit(0), bench).collect() == [] and d.leaks(df, bench.limit(0)).collect() == []


def test_turns_give_the_same(spark, monkeypatch):
    items = [(i, f"item number {i} says something quite of its own {i * i}") for i in range(30)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(d.leaks(docs, bench).collect())
    monkeypatch.setattr(d, "ITEMS_AT_ONCE", 10)
    assert sorted(d.leaks(docs, bench).collect()) == one and len(one) >= 30
    more = docs.unionByName(spark.createDataFrame([(99, "clean words of no item at all"), (None, None), (None, None)], docs.schema)).selectExpr("*", "1 AS _number")
    kept = d.without_leaks(more, bench)
    assert kept.columns == more.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["99", "None", "None"]


def test_multi_index_finds_all_within_radius(monkeypatch):
    rng = np.random.default_rng(0)
    items = d.Items.of(list(range(300)), [" ".join(f"x{rng.integers(50)}" for _ in range(30)) for _ in range(300)])
    (group,) = items.groups.values()
    prints = rng.integers(1 << 63, size=50, dtype=np.uint64)
    prints[:20] = group.prints[:20] ^ rng.integers(1 << 20, size=20, dtype=np.uint64)
    for cells in (1, 1000, 1 << 22):
        monkeypatch.setattr(d, "CELLS_AT_ONCE", cells)
        w, i = group.near(prints)
        want = np.argwhere(np.bitwise_count(prints[:, None] ^ group.prints[None, :]) <= d.RADIUS)
        assert sorted(zip(w.tolist(), i.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and len(want) >= 20


def test_long_item_is_found(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(3000)}" for _ in range(26_000)]
    said = item[:]
    for at in rng.sample(range(len(said)), 300):
        said[at] = "edited"
    other = [f"v{rng.randrange(3000)}" for _ in range(30_000)]
    docs = [(1, " ".join(other[:15_000] + said + other[15_000:])), (2, " ".join(other + item[:9_000])), (3, "a short item of six words here"), (4, " ".join(item[:25_000]))]
    items = [(1, " ".join(item)), (2, "A short item of six words")]
    assert len(items[0][1]) > 1 << 16
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in d.leaks(df, bench).collect()}
    assert got.keys() == {(1, 1), (3, 2), (4, 1)}
    x, y = bag(said), bag(item)
    low = (x & y).total()
    assert got[1, 1]["similarity"] == pytest.approx(low / (x.total() + y.total() - low), abs=1e-3) and abs(got[1, 1]["first_word"] - 15_000) < 30
    assert got[4, 1]["first_word"] == 0 and got[4, 1]["n_words"] == 25_000
    assert [r["doc_id"] for r in d.without_leaks(df, bench).collect()] == [2]


def test_turns_are_cut_by_bytes(spark, monkeypatch):
    items = [(i, f"item number {i} says something quite of its own {i * i}" + " and more" * (300 if i == 7 else 0)) for i in range(30)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    one = sorted(d.leaks(docs, bench).collect())
    monkeypatch.setattr(d, "BYTES_AT_ONCE", 200)
    turns = list(d._Turns.of(bench))
    assert len(turns) > 5 and sorted(i for t in turns for i in t.ids) == list(range(30))
    assert sorted(d.leaks(docs, bench).collect()) == one and len(one) >= 30


def test_common_against_counters(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(60):
        h, item = rng.integers(8, size=rng.integers(10, 60)).astype(np.uint64), rng.integers(6, size=rng.integers(1, 12)).astype(np.uint64)
        width = min(len(item), len(h))
        begin = np.arange(len(h) - width + 1)
        low = d.Bag(*np.unique(item, return_counts=True)).common(h, np.flatnonzero(np.isin(h, item)), begin, width)
        assert low.tolist() == [(Counter(h[a : a + width].tolist()) & Counter(item.tolist())).total() for a in begin]
    # windows wider than a stretch give what they give in one stretch
    text = " ".join(f"u{x}" for x in rng.integers(40, size=300))
    known = d.Items.of([1, 2], [" ".join(text.split()[100:180]), " ".join(text.split()[20:60])])
    _, h, _, _ = next(d._shingles(d.pa.array([text])))
    hits = np.flatnonzero(np.isin(h, known.shingles))
    whole = known.leaks(h, hits)
    monkeypatch.setattr(d, "WINDOWS_AT_ONCE", 16)
    assert known.leaks(h, hits) == whole and {k: v[2] for k, v in whole.items()} == {1: 100, 2: 20}
