"""Words of whole columns of text as 64-bit hashes, found with array operations over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # of text looked at in one go; a longer text is a chunk of its own
U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
NOT_SPACE = ~_SPACES
#: ASCII letters and digits, and every byte of a character beyond ASCII.
LETTERS_DIGITS = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
_BYTE_CODE = np.random.default_rng(20240501).integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[U(1)], np.full(max(0, n - 1), _P)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry: the end). Null texts are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``chunk_bytes``."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each maximal run of ``member`` bytes, A-Z lower-cased, and where each text's words begin (one more: the end).

    A hash sums code(byte) * P^place modulo 2^64 and is mixed with the length; two words of one corpus collide with a
    probability of about (number of words)^2 / 2^65.
    """
    n_docs = len(offsets) - 1
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    letters = _ASCII_LOWER[data[inside]]
    rank = np.cumsum(inside) - 1
    return run_hashes(letters, np.diff(np.append(rank[starts], len(letters)))), np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each of the runs of bytes, of these lengths, that make up ``data``."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    total = np.add.reduceat(_BYTE_CODE[data] * _powers(int(lengths.max()))[place], first)
    return mix(total + lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a text, and where each text's begin (one more: the end).

    A text of fewer than k words has one shingle, the whole sequence; a text without words has none.
    """
    counts = np.diff(begins)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_begins = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(out_begins[-1]) - np.repeat(out_begins[:-1], n) + np.repeat(begins[:-1], n)
    width = np.repeat(np.minimum(counts, k), n)
    total = np.zeros(len(place), np.uint64)
    for j in range(k):
        ok = width > j
        total[ok] = mix(total[ok] * _P + words[place[ok] + j])
    return total, out_begins
