import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe, packing, wavelet, words

PATH = bpe.tokenizer_path()
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "it's we'll 'tis", "1,234.5 €5 naïve Über-größe", "<|endoftext|> a <|endoftext|>", "a <|endoftext|>b c.",
       "tab\tsep  nbsp  em", "\x1c x \x85 y", "don't. stop! (now) [x] a.b c,d", "ΑΒΓ δεζ 漢字 テスト 🙂 🙂", "end.  ", "word" * 3000, "á é.", "ǅ ª º. ʰ"]


ENCODER = bpe.Encoder(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def direct(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids




def sample():
    folder = "/root/testdata/sf0.001/documents.parquet"
    return pq.read_table(folder, columns=["text"])["text"].to_pylist()[:60] if os.path.exists(folder) else []


def test_ids_equal_the_library():
    texts = [t or "" for t in ODD + sample()]
    enc = bpe.Encoder(PATH)
    for size in (1, 64, 1 << 20):
        got = {}
        for first, _, data, offsets in words.chunks(pa.array(texts, pa.string()), size):
            ids, begins = enc.encode(data, offsets)
            got.update({first + i: ids[begins[i] : begins[i + 1]].tolist() for i in range(len(begins) - 1)})
        for i, text in enumerate(texts):
            assert got[i] == direct(text), text


@given(st.lists(st.text(alphabet="ab Z9'strevl.,\n\t\u00e9\u00d7\u0142\u2019\u2014\u2028\u00a0\u4e2d|<-", max_size=24), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_of_odd_strings(texts):
    for _, _, data, offsets in words.chunks(pa.array(texts, pa.string())):
        ids, begins = ENCODER.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [direct(t) for t in texts]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1), (700, 3), (3000, 50257), (1024, 1 << 17)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        w = wavelet.WaveletMatrix.unpacked(n, *wavelet.WaveletMatrix.build(ids).packed())
        assert w.tokens().tolist() == ids.tolist()
        for i in rng.integers(0, n, 20) if n else []:
            assert w.access(int(i)) == ids[i]
            t, lo, hi = int(ids[i]), int(i) // 2, min(n, int(i) + 50)
            assert w.count(t, lo, hi) == (ids[lo:hi] == t).sum()
            at = np.flatnonzero(ids == t)
            assert [w.locate(t, k) for k in range(len(at))][:40] == at.tolist()[:40] and w.locate(t, len(at)) == -1
        assert w.count(1 << 20) == 0


def rows(spark):
    docs = [(i * 7 % 41, t) for i, t in enumerate(ODD + sample())] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS start", "1 AS length")


def test_shards_round_trip(spark):
    docs, df = rows(spark)
    got = wavelet.read_documents(wavelet.write_shards(df, PATH, shard_bytes=20_000)).collect()
    want = sorted((str(i), len(direct(t)) + 1, zlib.crc32(np.array(direct(t) + [2], "<u4").tobytes())) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert wavelet.read_documents(wavelet.write_shards(df.limit(0), PATH)).collect() == []


def test_access_count_and_locate(spark):
    """Ranks and selects of the written files give what the decoded ids give."""
    _, df = rows(spark)
    shards = wavelet.write_shards(df, PATH, shard_bytes=20_000)
    ids = np.concatenate([wavelet._matrix(b, i, False).tokens() for b in shards.orderBy("shard").toArrow().to_batches() for i in range(len(b))]).astype(int)
    asked = [2, int(ids[5]), int(ids[-7]), 49_999]
    assert shards.count() > 1 and {r["token"]: r["n"] for r in wavelet.count_tokens(shards, asked).collect()} == {t: int((ids == t).sum()) for t in asked}
    assert sorted(map(tuple, wavelet.locate_tokens(shards, asked).collect())) == sorted((t, int(i)) for t in set(asked) for i in np.flatnonzero(ids == t))
    places = [0, 1, 1, len(ids) - 1, len(ids), -1, len(ids) // 2, None]
    got = wavelet.tokens_at(shards, spark.createDataFrame([(p, "x") for p in places], "place long, token string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, int(ids[p])) for p in places if p is not None and 0 <= p < len(ids))
    none = wavelet.write_shards(df.limit(0), PATH)
    assert wavelet.count_tokens(none, [2]).collect() == [] and wavelet.locate_tokens(none, [2]).collect() == []


def test_cuts_of_one_hash_are_told_apart(monkeypatch):
    """A hash that is the same for all cuts of one length changes no id."""
    monkeypatch.setattr(words, "run_hashes", lambda data, lengths: lengths.astype(np.uint64))
    enc, texts = bpe.Encoder(PATH), [t or "" for t in ODD]
    for _, _, data, offsets in words.chunks(pa.array(texts, pa.string()), 200):
        ids, begins = enc.encode(data, offsets)
        got = [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        assert got == [direct(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_added_tokens_are_read_from_the_file(tmp_path):
    import json

    about = json.load(open(PATH, encoding="utf-8"))
    about["added_tokens"] = [*about.get("added_tokens", []), {"id": 60_000, "content": "[CUT]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    path = str(tmp_path / "more.json")
    json.dump(about, open(path, "w", encoding="utf-8"))
    library, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ["a [CUT] b", "[CU T] [x", "plain", "[CUT]", "x <| y", "<|endoftext|>"]
    ((_, _, data, offsets),) = words.chunks(pa.array(texts))
    ids, begins = enc.encode(data, offsets)
    got = [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and len(got[3]) == 1


def test_packing(spark):
    docs, df = rows(spark)
    got = packing.pack(df, PATH, capacity=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id in {i for i, _ in docs}:
        want = []
        for i, t in docs:
            if i == doc_id:
                ids = direct(t) + [2]
                first = len(ids) % 64 or 64
                cuts = [0, *range(first, len(ids) + 1, 64)]
                want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(want)
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= -(-total // 64) * 1.03 + 1
    assert packing.pack(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("rows_at_once", [50_000, 300])
def test_best_fit_matches_a_sequential_one(spark, monkeypatch, rows_at_once):
    """Each size in turn, in the order of sizes, to the smallest gap that holds it; in one task, and over several parts."""
    monkeypatch.setattr(packing, "ROWS_AT_ONCE", rows_at_once)
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.zipf(1.3, 4000), 100)
    sizes[:1500] = 37  # a third of all have one size
    df = spark.createDataFrame([(i, 0, int(s)) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    got = packing.best_fit(df, 100).groupBy("sequence_id").sum("length").collect()
    gaps = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(100 - s)
    assert len(got) <= len(gaps) * 1.005 + 1
    assert max(r[1] for r in got) <= 100 and sum(r[1] for r in got) == sizes.sum()


def brute_matches(line):
    """Each gap, from the smallest up, takes the largest document before it that none has taken."""
    stack, out = [], []
    for place, is_gap in enumerate(line):
        if not is_gap:
            stack.append(place)
        elif stack:
            out.append((stack.pop(), place))
    return sorted(out)


def test_superstep_against_a_stack(spark):
    rng = np.random.default_rng(5)
    for n, share in ((0, 0.5), (1, 0.5), (400, 0.5), (400, 0.1), (400, 0.9)):
        is_gap = rng.random(n) < share
        a, b = packing.sweep(np.arange(n), is_gap)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == brute_matches(is_gap)
    for share in (0.3, 0.6):
        is_gap = rng.random(500) < share
        size = np.sort(rng.integers(1, 40, 500))
        order = np.lexsort((np.arange(500), is_gap, size))
        line = spark.createDataFrame([(int(i), int(size[i]), bool(is_gap[i])) for i in order[rng.permutation(500)]], "id long, size long, is_gap boolean")
        got = sorted((int(r["doc"]), int(r["gap"])) for r in packing._superstep(line, 7).collect())
        assert got == sorted((int(order[a]), int(order[b])) for a, b in brute_matches(is_gap[order]))


def test_slots_hold_what_the_gap_has():
    gap, space = packing.slots(np.array([3, 10, 25, 1]), 4)
    assert np.bincount(gap, space).tolist() == [3, 10, 25, 1] and np.bincount(gap).tolist() == [1, 2, 6, 1]


def test_best_fit_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 0, 60, "a", 1, 2), (2, 0, 30, "b", 3, 4), (None, None, 10, None, None, None), (2, 0, 30, "b", 3, 4)],
                               "doc_id long, piece int, length long, _number string, gap long, offset long")
    out = packing.best_fit(df, 100)
    assert out.columns == ["doc_id", "piece", "length", "_number", "gap", "sequence_id", "offset"]
    got = sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert sorted(str(r["_number"]) for r in got) == ["None", "a", "b", "b"] and len({r["sequence_id"] for r in got}) == 2


def test_lengths_out_of_range(spark):
    for bad in ("0", "101", "NULL"):
        with pytest.raises(Exception, match="no length"):
            packing.best_fit(spark.sql(f"SELECT 1L doc_id, 0 piece, CAST({bad} AS BIGINT) length"), 100).collect()


def test_known_cuts_are_found_in_their_slots(monkeypatch):
    texts = [t or "" for t in ODD + sample()]
    (chunk,) = words.chunks(pa.array(texts, pa.string()), 1 << 30)
    enc = bpe.Encoder(PATH)
    want = enc.encode(*chunk[2:])
    unique, sorted_again = np.unique, []
    monkeypatch.setattr(bpe.np, "unique", lambda h, **how: sorted_again.append(len(h)) or unique(h, **how))
    for a, b in zip(want, enc.encode(*chunk[2:]), strict=True):
        assert (a == b).all()
    assert sum(sorted_again) < len(want[0]) / 20  # those alone whose slot another cut has


def test_cuts_that_share_slots(monkeypatch):
    monkeypatch.setattr(bpe, "SLOT_BITS", 2)
    test_ids_equal_the_library()
