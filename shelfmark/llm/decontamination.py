"""Benchmark decontamination by SimHash over item-sized windows.

A document leaks an item if some window of as many words as the item has a weighted shingle similarity to it of at least
the threshold. Such a window shares a shingle with the item, so fingerprints are made for all windows of an item's size
that hold one of its shingles, and for no others. Fingerprints are compared with those of the items of the window's size
by multi-index hashing: 64 bits in eight blocks, and any two fingerprints within ``RADIUS`` differ in at most RADIUS // 8
bits in some block. A block's index has a bitmap of items for each of its values; a batch of windows looks its values up
and takes the union over the blocks. What is within the radius is verified by the exact similarity.

An item of fewer than ``SHINGLE`` words is one shingle, its whole sequence, and a document that holds it leaks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words
from shelfmark.llm.storage import free, in_batches, written

SHINGLE = 5  # words
PERCENT = 80  # similarity at least
RADIUS = 23  # bits of 64; windows at the threshold are about 10 apart, and over 23 one time in a million
BLOCKS = 8  # of 8 bits
ITEMS_AT_ONCE = 20_000  # items that are broadcast; a larger benchmark is taken in turns, a pass over the documents each
BYTES_AT_ONCE = 16 << 20  # of their texts; a longer item has a turn of its own
WINDOWS_AT_ONCE = 20_000
CELLS_AT_ONCE = 1 << 22  # windows times items of a look-up


def _full(w: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and where each text's begin; a text of fewer words has none."""
    n = np.diff(begins)
    h, s_begins = words.shingles(w, begins, k)
    return h[np.repeat(n >= k, np.diff(s_begins))], np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each text's begin) of runs of texts. Words are runs of letters and digits, in lower case."""
    for first, last, _, _ in words.chunks(column):
        lower = pa.array([t.lower() if t else "" for t in column.slice(first, last - first).to_pylist()], pa.large_string())
        yield first, *words.word_hashes(*words.utf8(lower), words.LETTERS_DIGITS)


def _shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, where each text's begin, its number of words) of runs of texts."""
    for first, w, begins in _words(column):
        yield first, *_full(w, begins, SHINGLE), np.diff(begins)


def votes(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int8) << 1) - 1


def fingerprints(total: np.ndarray) -> np.ndarray:
    """SimHashes from sums of votes, one row each."""
    return np.packbits(total > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


@dataclass
class Bag:
    """An item's shingles, sorted, and how often it has each."""

    values: np.ndarray
    counts: np.ndarray

    def common(self, h: np.ndarray, places: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        """Sum of minima of the bag and the window of ``width`` shingles of ``h`` at each of ``begin``; ``places`` (sorted) has all of the bag's in them.

        A shingle that the bag has m times counts where the window doesn't hold its m-th occurrence before, so each
        occurrence counts for windows that begin after that one. This takes no more time for wide windows.
        """
        kind = np.minimum(np.searchsorted(self.values, h[places]), len(self.values) - 1)
        own = self.values[kind] == h[places]
        order = np.argsort(kind[own], kind="stable")
        kind, at = kind[own][order], places[own][order]
        before = np.arange(len(at)) - self.counts[kind]
        same = (before >= 0) & (kind[before] == kind)
        after = np.maximum(np.where(same, at[before], -1), at - width) + 1
        return np.searchsorted(np.sort(after), begin, "right") - np.searchsorted(np.sort(at), begin, "left")


def _total(h: np.ndarray) -> np.ndarray:
    """Sum of the votes of many hashes."""
    return sum((votes(h[lo : lo + WINDOWS_AT_ONCE]).sum(axis=0, dtype=np.int64) for lo in range(0, len(h), WINDOWS_AT_ONCE)), np.zeros(64, np.int64))


@dataclass
class Group:
    """The items of one size: their numbers, fingerprints, and for each block and value a bitmap of those within RADIUS // BLOCKS bits."""

    items: np.ndarray
    prints: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, items: list[int], prints: np.ndarray) -> Group:
        bits = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        near = np.packbits(bits <= RADIUS // BLOCKS, axis=1)  # of a value, those near
        parts = [(prints >> np.uint64(8 * b)).astype(np.uint8) for b in range(BLOCKS)]
        index = np.stack([np.packbits(np.unpackbits(near, axis=1)[:, part], axis=1) for part in parts])
        return cls(np.array(items), prints, index)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item) of all pairs within RADIUS bits."""
        found = []
        for lo in range(0, len(prints), max(1, CELLS_AT_ONCE // len(self.items))):
            some = prints[lo : lo + max(1, CELLS_AT_ONCE // len(self.items))]
            union = self.index[0][(some & np.uint64(255)).astype(np.int64)]
            for b in range(1, BLOCKS):
                union = union | self.index[b][(some >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
            w, i = np.nonzero(np.unpackbits(union, axis=1, count=len(self.items)))
            ok = np.bitwise_count(some[w] ^ self.prints[i]) <= RADIUS
            found.append((w[ok] + lo, self.items[i[ok]]))
        return np.concatenate([w for w, _ in found]), np.concatenate([i for _, i in found])


@dataclass
class Items:
    """A turn's items: what the tasks look up."""

    ids: list[int]
    bags: list[Bag]
    groups: dict[int, Group]  # by the number of shingles
    shingles: np.ndarray  # of all items, sorted
    begins: np.ndarray  # where each shingle's part of the next begins (one more: the end)
    sizes_of: np.ndarray  # sizes of the items that have it
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by words, fewer than SHINGLE: hashes of the items' sequences, sorted, and their ids

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        kept, bags, prints, pairs, groups, short = [], [], [], {}, {}, {}
        for first, w, w_begins in _words(pa.array(texts, pa.string())):
            h, begins = _full(w, w_begins, SHINGLE)
            n_words = np.diff(w_begins)
            for i in range(len(begins) - 1):
                own = h[begins[i] : begins[i + 1]]
                if len(own):
                    groups.setdefault(len(own), []).append(len(kept))
                    kept.append(ids[first + i])
                    bags.append(Bag(*np.unique(own, return_counts=True)))
                    prints.append(fingerprints(_total(own)[None])[0])
                    pairs.setdefault(len(own), []).append(bags[-1].values)
                elif n_words[i]:
                    short.setdefault(int(n_words[i]), []).append((_full(w[w_begins[i] : w_begins[i + 1]], np.array([0, n_words[i]]), int(n_words[i]))[0][0], ids[first + i]))
        prints = np.array(prints, np.uint64)
        parts = [(size, np.unique(np.concatenate(x))) for size, x in sorted(pairs.items())]
        x = np.concatenate([part for _, part in parts]) if parts else np.zeros(0, np.uint64)
        size_of = np.repeat(np.array([size for size, _ in parts], np.int64), [len(part) for _, part in parts])
        order = np.argsort(x, kind="stable")
        shingles, begins = np.unique(x[order], return_index=True)
        of_short = {k: tuple(map(np.array, zip(*sorted(v), strict=True))) for k, v in short.items()}
        return cls(kept, bags, {size: Group.of(g, prints[g]) for size, g in groups.items()}, shingles, np.append(begins, len(x)), size_of[order], of_short)

    def short_leaks(self, w: np.ndarray, begins: np.ndarray) -> dict[int, dict[int, tuple[int, int, int, int]]]:
        """For each text of a run, as ``leaks`` does, the short items whose sequence it holds, where it does first."""
        out: dict[int, dict] = {}
        for k, (hashes, ids) in self.short.items():
            h, k_begins = _full(w, begins, k)
            known = np.unique(hashes)
            hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            owner = np.searchsorted(k_begins, hits, "right") - 1
            for i, at in zip(owner.tolist(), hits.tolist(), strict=True):
                for item in ids[np.searchsorted(hashes, h[at], "left") : np.searchsorted(hashes, h[at], "right")].tolist():
                    out.setdefault(i, {}).setdefault(item, (1, 1, int(at - k_begins[i]), k))
        return out

    def leaks(self, h: np.ndarray, hits: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """Of a document's shingles and the places of those that some item has: for each item that leaks, (low, high, first word, words) of its best window."""
        kind = np.searchsorted(self.shingles, h[hits])
        n_sizes = np.diff(self.begins)[kind]
        place = np.repeat(hits, n_sizes)
        size_at = self.sizes_of[np.arange(len(place)) + np.repeat(self.begins[kind] - np.cumsum(n_sizes) + n_sizes, n_sizes)]
        order = np.argsort(size_at, kind="stable")
        sizes, first = np.unique(size_at[order], return_index=True)
        starts = dict(zip(sizes.tolist(), np.split(place[order], first[1:]), strict=True))
        best: dict[int, tuple[int, int, int, int]] = {}
        longest = max(starts)
        shared = max((size for size in starts if size <= WINDOWS_AT_ONCE), default=0)
        last: dict[int, tuple[int, np.ndarray]] = {}  # of wider windows: where one begins and its votes
        for lo in range(max(0, int(hits[0]) - longest + 1), int(hits[-1]) + 1, WINDOWS_AT_ONCE):  # windows that begin in this stretch
            sums = None
            for size, places in starts.items():
                width = min(size, len(h))  # a document shorter than the item is one window
                n = min(lo + WINDOWS_AT_ONCE, len(h) - width + 1) - lo
                near = places[np.searchsorted(places, lo) : np.searchsorted(places, lo + n + width - 1)]
                if n <= 0 or not len(near):
                    continue
                opens, closes = (np.bincount(np.clip(x - lo, 0, n), minlength=n + 1) for x in (near - width + 1, near + 1))
                begin = np.flatnonzero(np.cumsum(opens - closes)[:n] > 0)
                if size > WINDOWS_AT_ONCE:  # the votes of a wide window come from those of one before it
                    at, total = last.get(size, (lo - width, 0))
                    total = total + _total(h[at + width : lo + width]) - _total(h[at:lo]) if at + width > lo else _total(h[lo : lo + width])
                    last[size] = lo, total
                    gone, come = votes(h[lo : lo + n - 1]), votes(h[lo + width : lo + width + n - 1])
                    windows = (np.concatenate([total[None], total + np.cumsum(come, axis=0, dtype=np.int64) - np.cumsum(gone, axis=0, dtype=np.int64)]))[begin]
                else:
                    if sums is None:
                        some = votes(h[lo : lo + WINDOWS_AT_ONCE + shared])
                        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(some, axis=0, dtype=np.int32)])
                    windows = sums[begin + width] - sums[begin]
                place, found = self.groups[size].near(fingerprints(windows))
                order = np.argsort(found, kind="stable")
                place, found = place[order], found[order]
                kinds, edge = np.unique(found, return_index=True)
                for i, begun in zip(kinds.tolist(), np.split(begin[place] + lo, edge[1:]), strict=False):
                    lows = self.bags[i].common(h, near, begun, width)
                    k = int(lows.argmax())  # the first one of the most
                    low, high, a = int(lows[k]), width + size - int(lows[k]), int(begun[k])
                    if 100 * low < PERCENT * high:
                        continue
                    old = best.get(self.ids[i])
                    if old is None or (low * old[1], -a) > (old[0] * high, -old[2]):
                        best[self.ids[i]] = (low, high, a, width + SHINGLE - 1)
        return best


OUT = "doc_id long, item_id long, similarity double, first_word int, n_words int"


def _documents_that_leak(known: Items, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[int, int, int, int]]]]:
    """(row, what it leaks) for the rows of a batch that leak anything."""
    if not len(known.shingles) and not known.short:
        return
    for first, w, w_begins in _words(column):
        found = known.short_leaks(w, w_begins)
        if len(known.shingles):
            h, begins = _full(w, w_begins, SHINGLE)
            at = np.minimum(np.searchsorted(known.shingles, h), len(known.shingles) - 1)
            hits = np.flatnonzero(known.shingles[at] == h)
            owner = np.searchsorted(begins, hits, "right") - 1
            for i in np.unique(owner).tolist():
                a, b = begins[i], begins[i + 1]
                if long := known.leaks(h[a:b], hits[owner == i] - a):
                    found[i] = long | found.get(i, {})
        for i in sorted(found):
            yield int(first + i), found[i]


@dataclass
class _Turns:
    """The benchmark's items in turns of ITEMS_AT_ONCE items and BYTES_AT_ONCE of text at most, but where one part of the hash's range holds more."""

    items: DataFrame
    parts: int
    cuts: list[tuple[int, int]]

    @classmethod
    def of(cls, benchmark: DataFrame) -> _Turns:
        items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
        n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        turns = cls(items, 64 * max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE)), [])
        held = items.groupBy(turns._part().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy("part").collect()
        first, n, size = 0, 0, 0
        for r in held:
            if n and (n + r["n"] > ITEMS_AT_ONCE or size + r["size"] > BYTES_AT_ONCE):
                turns.cuts.append((first, r["part"]))
                first, n, size = r["part"], 0, 0
            n, size = n + r["n"], size + r["size"]
        turns.cuts.append((first, turns.parts))
        return turns

    def _part(self):
        return F.pmod(F.xxhash64("item_id", "text"), F.lit(self.parts))

    def __iter__(self) -> Iterator[Items]:
        for first, end in self.cuts:
            # an item that repeats is looked for once
            found = self.items.where((self._part() >= first) & (self._part() < end)).distinct().collect()
            yield Items.of([r["item_id"] for r in found], [r["text"] for r in found])


_KINDS = {"item_id": pa.int64(), "similarity": pa.float64(), "first_word": pa.int32(), "n_words": pa.int32()}


def _leaks(rows: DataFrame, key: str, benchmark: DataFrame) -> DataFrame:
    """Rows of ``key`` (long) and text to (key, item_id, similarity, first_word, n_words). With more turns than one, each one's rows are written before the next begins."""
    turns = _Turns.of(benchmark)

    def one(items: Items) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            for batch in batches:
                keys = batch.column(key)
                out = [(i, item, low / high, word, n) for i, found in _documents_that_leak(shared.value, batch.column("text")) for item, (low, high, word, n) in found.items()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in out], pa.int64())), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate(_KINDS.values(), 1))],
                                                 [key, *_KINDS])

        found = in_batches(rows).mapInArrow(run, f"{key} long, item_id long, similarity double, first_word int, n_words int")
        if len(turns.cuts) == 1:
            return found
        found = written(found, "leaks")
        shared.destroy()
        return found

    return reduce(DataFrame.unionByName, map(one, turns))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it leaks: doc_id, item_id, similarity, first_word, n_words of the best window.

    Of equally similar windows the first one counts. Words are runs of letters and digits (and any character beyond
    ASCII) in lower case. Items without words, null items and items with a null id take no part; an item of fewer than
    SHINGLE words leaks where its whole sequence of words stands. Of items that share an id, each is looked for, and the
    best window of a turn counts. Items and texts of any length count whole. Null and empty texts leak nothing. A row of
    ``docs`` that repeats gives its rows again. Other columns are left out. No item or no document gives no row.
    """
    return _leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; see ``leaks``."""
    turns = _Turns.of(benchmark)
    if len(turns.cuts) > 1:  # rows are numbered, and the numbers of those that leak put together turn by turn
        (number,) = free(docs, "_number")
        numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        found = _leaks(numbered.select(number, "text"), number, benchmark).select(number).distinct()
        return numbered.join(found, number, "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(next(iter(turns)))

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[i for i, _ in _documents_that_leak(shared.value, batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return in_batches(docs).mapInArrow(run, docs.schema)
