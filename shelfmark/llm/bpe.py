"""Token ids of whole texts by a public tokenizer file, through the tokenizers library.

Byte-level BPE first cuts a text into words, numbers, runs of other signs and white space, and then merges inside each
cut. Texts repeat their cuts, so the cuts of a batch are found by array operations over its bytes, each different one is
given to the library's model once, and a worker keeps the ids. Texts with characters whose kind can't be told from a
short table here are given to the library whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shelfmark.llm import words

KEPT_CUTS = 400_000  # different cuts whose ids a worker keeps; beyond it starts anew
SLOT_BITS = 21  # slots in which a known cut is looked for first: 2 ** this
CHUNK_BYTES = 4 << 20  # of text encoded in one go
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[[*range(ord("0"), ord("9") + 1)]] = DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        pre = about.get("pre_tokenizer") or {}
        #: Whether words of letters alone can go straight to the model.
        self.plain = (about["model"]["type"] == "BPE" and not about.get("normalizer") and pre.get("type") == "ByteLevel"
                      and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about["model"].get("dropout"))
        self.added = [t["content"].encode() for t in about.get("added_tokens") or [] if t["content"]]
        self.letters = _printable_bytes()
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of the cuts, sorted, and their numbers
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slots, self.hashes = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(0, np.uint64)  # by a hash's first bits, one cut's number; each number's hash
        self.said, self.said_at, self.said_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the cuts' own bytes

    def _learn(self, keys: np.ndarray, cuts: list[bytes]) -> None:
        """Keeps the ids of new cuts; ``keys`` are sorted."""
        found = [[t.id for t in self.model.tokenize(c.decode("latin-1").translate(self.letters))] for c in cuts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        self.said_at = np.append(self.said_at, len(self.said) + np.cumsum(sizes) - sizes)
        self.said_size = np.append(self.said_size, sizes)
        self.said = np.append(self.said, np.frombuffer(b"".join(cuts), np.uint8))
        at = np.searchsorted(self.keys, keys)
        numbers = len(self.keys) + np.arange(len(keys))
        self.place = np.insert(self.place, at, numbers)
        self.keys = np.insert(self.keys, at, keys)
        self.hashes = np.append(self.hashes, keys)
        slot = keys >> np.uint64(64 - SLOT_BITS)
        empty = self.slots[slot] < 0
        self.slots[slot[empty]] = numbers[empty]
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())))

    def _numbers(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of cuts by their hashes; new ones are learnt. What isn't in its slot is sorted and looked for among all."""
        number = self.slots[h >> np.uint64(64 - SLOT_BITS)].astype(np.int64)
        if len(self.hashes):
            rest = np.flatnonzero((number < 0) | (self.hashes[number] != h))
        else:
            rest = np.arange(len(h))
        if len(rest):
            keys, first, which = np.unique(h[rest], return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            if len(self.keys):
                known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            new = np.flatnonzero(~known)
            raw, first = data.tobytes(), rest[first[new]]
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            number[rest] = self.place[np.searchsorted(self.keys, keys)][which]
        return number

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, with the texts of ``whole`` given to the library and the others each on its own."""
        out = []
        for i, by_library in enumerate(whole):
            text = data[offsets[i] : offsets[i + 1]]
            if by_library:
                out.append(np.array(self.tokenizer.encode(text.tobytes().decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.encode(text, np.array([0, len(text)]))[0])
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin (one more: the end)."""
        kind, hard = kinds(data, offsets)
        hard[np.searchsorted(offsets, found_anywhere(data, self.added), "right") - 1] = True
        if not self.plain:
            hard[:] = True
        n_docs = len(offsets) - 1
        if len(self.keys) > KEPT_CUTS:
            self._clear()
        starts = cut_starts(data, offsets, kind)
        starts = starts[~hard[np.searchsorted(offsets, starts, "right") - 1]] if hard.any() else starts
        ends = np.append(starts[1:], len(data))
        ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, "right")])
        flat, begins = np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        if len(starts):
            size = ends - starts
            inside = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum()) if hard.any() else slice(int(starts[0]), len(data))
            h = words.run_hashes(data[inside], size)
            number = self._numbers(h, data, starts, ends)
            # cuts of one hash that are not the same bytes: their texts go to the library
            other = self.said_size[number] != size
            if not other.any():
                begin = np.cumsum(size) - size
                differs = self.said[np.arange(size.sum()) + np.repeat(self.said_at[number] - begin, size)] != data[inside]
                other = np.add.reduceat(differs, begin, dtype=np.int64) > 0 if differs.any() else other
            if other.any():
                again = hard.copy()
                again[np.searchsorted(offsets, starts[other], "right") - 1] = True
                return self._mixed(data, offsets, again)
            lengths = self.lengths[number]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.ids[np.arange(upto[-1]) + np.repeat(self.starts[number] - upto[:-1], lengths)]
            begins = upto[np.searchsorted(starts, offsets)]
        if hard.any():
            rows = np.flatnonzero(hard)
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass") for i in rows]
            said = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            flat = np.insert(flat, np.repeat(begins[rows], [len(x) for x in said]), np.concatenate(said))
            more = np.zeros(n_docs + 1, np.int64)
            more[rows + 1] = [len(x) for x in said]
            begins = begins + np.cumsum(more)
        return flat, begins


def kinds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte's character, and which texts hold characters that the table here doesn't tell.

    It tells ASCII, the Latin letters from U+00C0 to U+024F and the dashes, quotes and dots from U+2010 to U+2027.
    """
    kind = _KIND[data]
    wide = data >= 0x80
    hard = np.zeros(len(offsets) - 1, bool)
    if wide.any():
        then = np.append(data[1:], 0)
        lead = np.flatnonzero(data >= 0xC0)
        a, b = data[lead], then[lead]
        latin = ((a == 0xC3) & (b != 0x97) & (b != 0xB7)) | ((a >= 0xC4) & (a <= 0xC8)) | ((a == 0xC9) & (b <= 0x8F))
        third = np.append(data[2:], [0, 0])[lead]
        sign = (a == 0xE2) & (b == 0x80) & (third >= 0x90) & (third <= 0xA7)
        kind[lead[latin]] = LETTER
        kind[lead[latin] + 1] = LETTER
        hard[np.searchsorted(offsets, lead[~(latin | sign)], "right") - 1] = True
    return kind, hard


def found_anywhere(data: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Places of the first bytes of these tokens; one that reaches over a text's end counts as well."""
    raw, places = None, [np.zeros(0, np.int64)]
    for two in {t[:2] for t in tokens}:
        at = np.flatnonzero(data == two[0])
        if len(two) > 1:
            at = at[at + 1 < len(data)]
            at = at[data[at + 1] == two[1]]
        if len(at):
            raw = raw or data.tobytes()
            own = tuple(t for t in tokens if t[:2] == two)
            places.append(np.array([a for a in at.tolist() if raw.startswith(own, a)], np.int64))
    return np.concatenate(places)


def cut_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the cuts begin: runs of one kind, a single space before a run being its first character.

    Of white space before a run, all but the last character is one cut; the last is the run's first if it is a space,
    else a cut of its own. White space at a text's end is one cut. An English ending after an apostrophe is a cut.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[begin[:n]] = 255
    start = kind != before
    space = kind == SPACE
    left = np.append(np.uint8(0), data[:-1])
    start &= ~(~space & (before == SPACE) & (left == 0x20))
    after = np.append(kind[1:], np.uint8(255))
    after[begin[1:]] = 255
    start |= space & (before == SPACE) & (after != SPACE) & (after != 255)
    mark = np.flatnonzero((data == ord("'")) & start & (after == LETTER))
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        m = len(ending)
        hit = mark[mark + m < n]
        for j, c in enumerate(ending):
            hit = hit[(data[hit + 1 + j] == c) & ~begin[hit + 1 + j]]
        start[hit + 1] = False
        rest = hit[hit + 1 + m < n] + 1 + m
        start[rest[(kind[rest] == LETTER) & ~begin[rest]]] = True
    return np.flatnonzero(start)


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with ``end_id`` after each text, begins) of runs of whole texts; null texts are empty."""
    enc = encoder(path)
    for first, _, data, offsets in words.chunks(column, CHUNK_BYTES):
        ids, begins = enc.encode(data, offsets)
        yield first, np.insert(ids, begins[1:], end_id).astype(np.uint32), begins + np.arange(len(begins))
