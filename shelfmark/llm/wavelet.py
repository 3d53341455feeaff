"""Token ids in one compressed file a shard: a wavelet matrix.

A shard's ids are stored as bit planes, the highest bit first. Below each plane the ids are in the order in which those
with a 0 bit come first, then those with a 1 bit, both as they stood. With the ones counted up to every 512th bit, rank
takes one look at a plane, and a token's value, its number of occurrences in a range and the place of its n-th
occurrence take one rank or select a plane, without the other tokens being decoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bpe
from shelfmark.llm.sharding import running
from shelfmark.llm.storage import written

SHARD_BYTES = 16 << 20  # of text in one shard, on average
BROADCAST_SHARDS = 1_000_000  # up to so many shards (12 bytes each) their starts are broadcast
BLOCK = 512  # bits between two stored ranks
FILE = "shard int, n_tokens long, doc_ids array<long>, begins array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """``planes``: the bits of each plane, packed; ``ranks``: ones before each block of 512; ``zeros``: zeros of each plane."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for level in range(width - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit))
            ranks.append(cls._count(planes[-1], len(x)))
            ones = np.flatnonzero(bit)
            zeros.append(len(x) - len(ones))
            x = np.concatenate([x[np.flatnonzero(~bit)], x[ones]])
        return cls(len(ids), planes, ranks, zeros)

    @staticmethod
    def _count(plane: np.ndarray, n: int) -> np.ndarray:
        """Ones before each block."""
        whole = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        whole[: len(plane)] = plane
        per = np.bitwise_count(whole).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)])[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for level in range(len(self.planes)):
            ones = self.rank(level, i)
            bit = self.rank(level, i + 1) - ones
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self.rank(level, lo), self.rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token is in places lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the token's k-th (from 0) occurrence; -1 if it has none."""
        lo, hi = self._range(token, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        x = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for place, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane)[: self.n].view(bool)
            above = np.empty_like(x)
            above[np.flatnonzero(~bit)], above[np.flatnonzero(bit)] = x[:zeros], x[zeros:] | x.dtype.type(1 << place)
            x = above
        return x

    def packed(self) -> tuple[list[int], list[bytes], list[bytes]]:
        press = zstandard.ZstdCompressor(level=1).compress
        return self.zeros, [press(p.tobytes()) for p in self.planes], [press(r.tobytes()) for r in self.ranks]

    @classmethod
    def unpacked(cls, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> WaveletMatrix:
        """``planes`` and ``ranks`` as ``packed`` gave them; without ranks, only ``tokens`` can be asked."""
        undo = zstandard.ZstdDecompressor().decompress
        return cls(n, [np.frombuffer(undo(p), np.uint8) for p in planes], [np.frombuffer(undo(r), np.uint32) for r in ranks], zeros)


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes all texts of ``docs`` (doc_id, text) and writes one row and part file a shard; returns the files read back.

    Shards follow each other in ascending doc_id order (null ids first, equal ids by a hash of the text). A null text is
    empty and has the end id alone. Rows that repeat are stored again. An empty table gives no shard. Other columns are
    left out. ``path`` is the tokenizer file; a task holds one shard.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(int(max(1, -(-size // shard_bytes))), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        doc_ids, lengths, ids = [], [], []
        for batch in batches:
            doc_ids.append(batch.column("doc_id"))
            for _, got, begins in bpe.encoded(batch.column("text"), path, end_id):
                ids.append(got.astype(np.uint16) if got.max() < 1 << 16 else got)
                lengths.append(np.diff(begins))
        if not lengths:
            return
        lengths = np.concatenate(lengths)
        zeros, planes, ranks = WaveletMatrix.build(np.concatenate(ids)).packed()
        begins = np.concatenate([[0], np.cumsum(lengths)])
        row = {"shard": [TaskContext.get().partitionId()], "n_tokens": [int(begins[-1])], "doc_ids": [pa.chunked_array(doc_ids).to_pylist()],
               "begins": [begins.tolist()], "zeros": [zeros], "planes": [planes], "ranks": [ranks]}
        kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.binary())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    return written(ordered.mapInArrow(run, FILE), "wavelet")


def _starts(shards: DataFrame) -> DataFrame:
    """(shard, first): how many ids all shards before it have."""
    first = running(shards.select("shard", "n_tokens"), "shard", "n_tokens", "first")
    return F.broadcast(first) if first.count() <= BROADCAST_SHARDS else first


def _matrix(batch: pa.RecordBatch, i: int, with_ranks: bool) -> WaveletMatrix:
    n, zeros, planes = (batch.column(c)[i].as_py() for c in ("n_tokens", "zeros", "planes"))
    return WaveletMatrix.unpacked(n, zeros, planes, batch.column("ranks")[i].as_py() if with_ranks else [])


def read_documents(shards: DataFrame) -> DataFrame:
    """One row a document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = _matrix(batch, i, with_ranks=False).tokens()
                begins = batch.column("begins")[i].values.to_numpy()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins[:-1], begins[1:], strict=True)]
                shard = pa.array(np.full(len(crc), batch.column("shard")[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([shard, batch.column("doc_ids")[i].values, pa.array(begins[:-1]), pa.array(np.diff(begins)), pa.array(crc, pa.int64())],
                                                 ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "n_tokens", "doc_ids", "begins", "zeros", "planes").mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(_starts(shards), "shard").select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _asked(shards: DataFrame, tokens: list[int], answer) -> DataFrame:
    """Rows (shard, token, n) that ``answer`` gives for each shard's matrix and each token."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                matrix = _matrix(batch, i, with_ranks=True)
                found = [(token, n) for token in tokens for n in answer(matrix, token)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[i].as_py()] * len(found), pa.int32()), pa.array([t for t, _ in found], pa.int64()),
                                                  pa.array([n for _, n in found], pa.int64())], ["shard", "token", "n"])

    return shards.select("shard", "n_tokens", "zeros", "planes", "ranks").mapInArrow(run, "shard int, token long, n long")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of ``tokens`` (different ones) stands in all shards, by two ranks a plane; no id is decoded."""
    return _asked(shards, tokens, lambda matrix, token: [matrix.count(token)]).groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, place): every place among all ids where one of ``tokens`` stands, by a select a plane; no id is decoded."""
    every = lambda matrix, token: (matrix.locate(token, k) for k in range(matrix.count(token)))
    return _asked(shards, tokens, every).join(_starts(shards), "shard").select("token", (F.col("n") + F.col("first")).alias("place"))


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (place long, other columns are left out) with the token there, by a rank a plane; places past the end and nulls give no row."""
    bounds = shards.select("shard", "n_tokens").join(_starts(shards), "shard").select("shard", "first", (F.col("first") + F.col("n_tokens")).alias("end"))
    inside = places.select("place").join(bounds, (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))).select(
        F.col("shard").alias("of"), "place", (F.col("place") - F.col("first")).alias("at"))

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        matrix = _matrix(shard.to_batches()[0], 0, with_ranks=True)
        return pa.table({"place": asked["place"], "token": pa.array([matrix.access(i) for i in asked["at"].to_pylist()], pa.int64())})

    held = shards.join(inside.select(F.col("of").alias("shard")).distinct(), "shard", "left_semi").select("shard", "n_tokens", "zeros", "planes", "ranks")
    return inside.groupBy("of").cogroup(held.groupBy("shard")).applyInArrow(run, "place long, token long")
