"""Toxicity by bags of subwords: n-gram embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of its own; a passage is the mean of the words
of a window; a linear softmax over it gives the probability that it is toxic, and a text is as toxic as its worst
passage. Training first takes all passages of a toxic text as toxic, then only its worst one. (Averaged over a whole text,
a few toxic words are lost among all others; README has the figures.)
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.storage import in_batches, written

BUCKETS = 1 << 16
DIMENSIONS = 12
ORDERS = (3, 4, 5)  # lengths of the n-grams, with a mark before and after the word
WINDOW = 6  # words of a passage
MAX_TRAINING_ROWS = 8000  # labelled rows drawn for the bounded training sample, half of each class
MAX_TRAINING_BYTES = 32 << 20  # of all texts drawn together: what the driver holds
ALL_STEPS, WORST_STEPS, BATCH = 150, 550, 64  # steps on all passages, then on the worst ones; texts of a step
WORDS_AT_ONCE = 50_000  # words whose subwords are found in one go
HELD_WORDS = 100_000  # words of texts that are scored in one go
KEPT_WORDS = 150_000  # words whose value a worker keeps
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased; one that is said again and again in a row counts once."""
    return [w for w, _ in groupby(WORD.findall((text or "").lower()))]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and where each word's begin (one more: the end)."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(begins[1:], lengths) - np.arange(len(chars))  # characters up to the word's end
    found, owners = [], []
    step = np.uint32(0x01000193)
    h = np.zeros(len(chars), np.uint32)
    for j in range(max(ORDERS)):
        n = len(chars) - j
        if n <= 0:
            break
        h = (h[:n] ^ chars[j:]) * step
        h ^= h >> np.uint32(13)
        if j + 1 in ORDERS:
            ok = left[:n] > j
            found.append(h[ok])
            owners.append(owner[:n][ok])
    whole = np.add.reduceat((chars * np.uint32(2654435761) ^ (chars << np.uint32(7))) * (left.astype(np.uint32) * np.uint32(40503) + np.uint32(1)), begins[:-1], dtype=np.uint32) if len(words) else h[:0]
    found.append(whole ^ (whole >> np.uint32(16)))
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found)[order] & np.uint32(BUCKETS - 1)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words) + 1))


def many_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``subwords``, some words at a time and in two bytes each, as the words of a training sample take a lot of room."""
    parts = [subwords(words[lo : lo + WORDS_AT_ONCE]) for lo in range(0, len(words), WORDS_AT_ONCE)]
    parts = [(subs.astype(np.uint16), np.diff(begins)) for subs, begins in parts]
    return np.concatenate([subs for subs, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])


@dataclass
class Model:
    embed: np.ndarray
    weight: np.ndarray
    bias: float

    def values(self) -> np.ndarray:
        """What each subword adds to the log-odds of a passage, times its share: the softmax is linear in the embeddings."""
        return self.embed @ self.weight


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, grad, rate):
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        return rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def passages(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the largest mean over WINDOW neighbouring words (over all, if fewer) and where that window begins; -inf without words."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    counts = np.diff(begins)
    width = np.minimum(counts, WINDOW)
    n = np.where(counts > 0, counts - width + 1, 0)
    at = np.arange(n.sum()) + np.repeat(begins[:-1] - np.cumsum(n) + n, n)
    w = np.repeat(width, n)
    mean = (sums[at + w] - sums[at]) / np.maximum(w, 1)
    best, where = np.full(len(counts), -np.inf), begins[:-1].copy()
    some = n > 0
    if some.any():
        edge = (np.cumsum(n) - n)[some]
        best[some] = np.maximum.reduceat(mean, edge)
        hit = np.flatnonzero(mean == np.repeat(best[some], n[some]))
        owner = np.searchsorted(edge, hit, "right") - 1
        first = np.unique(owner, return_index=True)[1]
        where[np.flatnonzero(some)] = at[hit[first]]
    return best, where


def fit(texts: Iterable[str], labels: np.ndarray, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.1, DIMENSIONS).astype(np.float32), 0.0)
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    labels, docs = labels[[len(d) > 0 for d in docs]], [d for d in docs if len(d)]
    if not docs or labels.min() == labels.max():
        return Model(model.embed * 0, model.weight * 0, 3.0 if len(labels) and labels.min() else -3.0)
    subs, sub_begins = many_subwords(list(number))
    number.clear()
    adam, adam_w, adam_b = _Adam(model.embed.shape), _Adam(DIMENSIONS), _Adam(())
    order = np.zeros(0, np.int64)
    for step in range(ALL_STEPS + WORST_STEPS):
        if len(order) < min(BATCH, len(docs)):
            order = rng.permutation(len(docs))
        pick, order = order[:BATCH], order[BATCH:]
        rate = 0.02 if step < ALL_STEPS + WORST_STEPS // 2 else 0.007
        flat = np.concatenate([docs[i] for i in pick])
        begins = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        words, local = np.unique(flat, return_inverse=True)
        n_sub = np.diff(sub_begins)[words]
        at = np.arange(n_sub.sum()) + np.repeat(sub_begins[words] - np.cumsum(n_sub) + n_sub, n_sub)
        used, sub = np.unique(subs[at], return_inverse=True)
        share = np.repeat(1 / n_sub, n_sub).astype(np.float32)
        edges = np.cumsum(n_sub) - n_sub
        # one dimension at a time: a step's longest texts would take a lot of room otherwise
        vectors = np.stack([np.add.reduceat(model.embed[used, d][sub] * share, edges) for d in range(DIMENSIONS)], axis=1)
        if step < ALL_STEPS:  # passages of all places
            start = np.concatenate([np.arange(a, max(a + 1, b - WINDOW + 1), WINDOW) for a, b in zip(begins[:-1], begins[1:], strict=True)])
        else:  # each text's worst one, and one more of each clean text
            start = passages((vectors @ model.weight)[local], begins)[1]
            clean = np.flatnonzero(labels[pick] == 0)
            start = np.concatenate([start, begins[clean] + (rng.random(len(clean)) * np.maximum(1, np.diff(begins)[clean] - WINDOW + 1)).astype(np.int64)])
        owner = np.searchsorted(begins, start, "right") - 1
        width = np.minimum(begins[owner + 1] - start, WINDOW)
        inside = np.arange(width.sum()) + np.repeat(start - np.cumsum(width) + width, width)
        mean = np.add.reduceat(vectors[local[inside]], np.cumsum(width) - width, axis=0) / width[:, None]
        p = 1 / (1 + np.exp(-(mean @ model.weight + model.bias)))
        g = ((p - labels[pick][owner]) / len(start)).astype(np.float32)
        per_word = np.bincount(local[inside], np.repeat(g / width, width), minlength=len(words)).astype(np.float32)
        grad_used = np.bincount(sub, np.repeat(per_word, n_sub) * share, minlength=len(used)).astype(np.float32)
        grad = np.zeros_like(model.embed)
        grad[used] = grad_used[:, None] * model.weight[None, :]
        grad_w = mean.T @ g + 1e-4 * model.weight
        model.embed -= adam.step(grad, rate)
        model.weight -= adam_w.step(grad_w.astype(np.float32), rate)
        model.bias -= float(adam_b.step(np.float32(g.sum()), rate))
    return model


class Scorer:
    """Scores texts, keeping the value of each word it has met."""

    def __init__(self, model: Model):
        self.values, self.bias = model.values(), model.bias
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.of = np.zeros(1024)

    def _learn(self, new: list[str]) -> None:
        n = len(self.number)
        while n + len(new) > len(self.of):
            self.of = np.resize(self.of, 2 * len(self.of))
        for lo in range(0, len(new), WORDS_AT_ONCE):
            some = new[lo : lo + WORDS_AT_ONCE]
            subs, begins = subwords(some)
            self.of[n + lo : n + lo + len(some)] = np.add.reduceat(self.values[subs], begins[:-1], dtype=np.float64) / np.diff(begins)
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def _best(self, held: list[str], sizes: list[int]) -> np.ndarray:
        if len(self.number) > KEPT_WORDS:
            self._clear()
        self._learn([w for w in set(held) if w not in self.number])
        v = self.of[np.fromiter(map(self.number.__getitem__, held), np.int64, len(held))]
        return passages(v, np.concatenate([[0], np.cumsum(sizes)]))[0]

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        out = []
        held, sizes = [], []
        for text in texts:
            found = words_of(text)
            held += found
            sizes.append(len(found))
            if len(held) > HELD_WORDS:
                out.append(self._best(held, sizes))
                held, sizes = [], []
        if sizes:
            out.append(self._best(held, sizes))
        logit = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


_scorers: dict = {}


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of MAX_TRAINING_ROWS ids at most, half of each class, drawn by hash from the ids that ``docs`` has.

    Texts of any length are drawn, and whole; of an id's texts one is taken. Rows are left out in the order of the draw
    once those before them take MAX_TRAINING_BYTES. The ids drawn are broadcast, so that no other text is shuffled.
    """
    known = labels.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    turn = F.xxhash64(F.lit(41), "doc_id")
    drawn = [known.where(F.col("toxic") == c).orderBy(turn, "doc_id").limit(MAX_TRAINING_ROWS // 2) for c in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]).select("doc_id", "toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
    sample = written(texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "toxic", "x.text"), "sample")
    before = F.sum("size").over(Window.orderBy(turn, "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # ids and sizes of the sample alone
    fits = sample.select("doc_id", F.octet_length("text").alias("size")).withColumn("before", before).where(f"coalesce(before, 0) < {MAX_TRAINING_BYTES}")
    return sample.join(fits.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of ``labels`` (doc_id, toxic 0 or 1); see ``training_sample``."""
    found = training_sample(docs, labels).toArrow().sort_by("doc_id")
    return fit((text.as_py() for text in found["text"]), found["toxic"].to_numpy().astype(np.int64))


def score_texts(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: 0 to 1, higher where toxic is likelier; a text without words has the lowest score there is."""
    docs = docs.drop(score_col)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        if name not in _scorers:  # a worker keeps the scorer, and the words it knows, from task to task
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        for batch in batches:
            s = _scorers[name].scores(text.as_py() for text in batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, score_col])

    return in_batches(docs).mapInArrow(run, docs.withColumn(score_col, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, is_training: Column, score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``score_col``, learnt from rows of ``labels`` (doc_id, toxic) where ``is_training`` (of doc_id) holds.

    A label row whose toxic is null or no 0 or 1, or whose id no document has, is left out; of rows that repeat an id
    the larger label holds. Null or empty texts and texts without letters or digits get the lowest score. Repeated rows
    are scored each, texts of any length whole; a column of that name in ``docs`` is replaced; an empty table gives no rows,
    and without labels of both classes every text with words gets one score.
    """
    kept = labels.where(is_training & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score_texts(docs, train(docs, kept), score_col)
