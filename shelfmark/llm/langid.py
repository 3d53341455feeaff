"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass counts the n-grams of each language into a fixed number of buckets; Spark adds up the tasks' sparse counts. The
log-probability matrix (buckets by languages) is broadcast and texts are scored in batches: the n-grams of a batch are
the column indices of a sparse matrix, and its product with the matrix is a row look-up and a sum for each text. Languages
are taken in blocks of ``LANGUAGES_AT_ONCE``; a text carries its best ones from block to block.

A text's fit says how plainly it reads as its language: its log-odds a character, as a share of what the language's own
n-grams give on average, against the next likely language or against noise (the language's characters drawn one by one),
whichever is less. It is about 1 for plain text, near 0 for texts of several languages, and about 0 or below for letters
without sense and for languages that were not learned: a letter that no learned language uses counts against the text as
much as a plain character counts for it. The log-odds of few characters vary; ``slack`` standard errors may be added to the
fit, so that one threshold has the same meaning at every length. Numbers, addresses and the like say nothing of a language
and may be masked.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.storage import free, in_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)  # lengths of the n-grams, in characters
LANGUAGES_AT_ONCE = 256  # bounds what is broadcast at once: BUCKETS * LANGUAGES_AT_ONCE * 4 bytes
CHUNK_CHARS = 1 << 19
SMOOTHING = 0.5
USED = 1e-5  # a letter is a language's own if it is that share of its characters at least
#: Runs that hold a digit or an @, web addresses.
NOT_PROSE = r"(?<!\S)(?=[^\s0-9@]*(?:[0-9@]|://)|www\.)\S+"
_LETTER = re.compile(r"[^\W\d_]")


def _chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points with a space after each text, begins) of runs of whole lower-cased texts.

    A text of more than CHUNK_CHARS is a run of its own.
    """
    def run():
        begins = np.concatenate([[0], np.cumsum([len(t) for t in held])])
        return first, np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32), begins

    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower() + " "
        if held and size + len(text) > CHUNK_CHARS:
            yield run()
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield run()


def _prose(texts: pa.Array, mask: str | None) -> Iterator[str | None]:
    """The texts, without what ``mask`` finds and with one space where there was white space; as they are without a mask."""
    found = re.compile(mask) if mask else None
    for text in texts:
        text = text.as_py()
        yield " ".join(found.sub(" ", text).split()) if found and text else text


def _buckets(chars: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each character; those past a text's end take in the space and what follows it."""
    h = np.zeros(len(chars) - order + 1, np.uint32)
    for j in range(order):
        h = (h ^ chars[j : j + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h + np.uint32(order * 7919)) & np.uint32(BUCKETS - 1)


def _grams(chars: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, begins) of each order, over the texts' own characters and the space after them."""
    for order in ORDERS:
        if len(chars) < order:
            continue
        b = _buckets(chars, order)
        # an n-gram that begins in a text's last places would reach into the next text
        inside = np.ones(len(b), bool)
        for back in range(1, order):
            ends = begins[1:] - back
            inside[ends[(ends >= 0) & (ends < len(b))]] = False
        upto = np.concatenate([[0], np.cumsum(inside)])
        yield b[inside], upto[np.minimum(begins, len(b))]


@dataclass
class Model:
    """A block of languages."""

    languages: list[str]
    prior: np.ndarray  # log, by language
    weights: np.ndarray  # log probability, bucket by language
    apart: np.ndarray  # log-odds a character that a text of the language has on average against the nearest other one of the block
    ordered: np.ndarray  # the same against noise
    spread: np.ndarray | None = None  # standard error of a one-character text's share of ``apart``, its n-grams taken as wholly dependent
    noise_spread: np.ndarray | None = None  # the same of its share of ``ordered``, noise taken to vary as much as the language
    used: np.ndarray | None = None  # whether a language of the block uses the characters of a bucket

    def __post_init__(self) -> None:
        """A model that is given without them has no errors, and its languages use every character."""
        n = len(self.languages)
        self.spread = np.zeros(n) if self.spread is None else self.spread
        self.noise_spread = np.zeros(n) if self.noise_spread is None else self.noise_spread
        self.used = np.ones(len(self.weights), bool) if self.used is None else self.used


def train(rows: DataFrame, per_lang: dict[str, int], mask: str | None = None) -> Model:
    """``rows``: text, lang (not null); ``per_lang``: how many rows each language to learn has, and under None all others. Counts cover every row."""
    languages = sorted(x for x in per_lang if x is not None)
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        counts = np.zeros(len(languages) * 2 * BUCKETS, np.int64)  # of all n-grams of each language, then of its characters
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, chars, begins in _chunks(_prose(batch.column("text"), mask)):
                for order, (b, at) in zip(ORDERS, _grams(chars, begins)):  # noqa: B905  the longest orders may be missing
                    found = np.bincount(b + np.repeat(lang[first : first + len(at) - 1] * 2 * BUCKETS, np.diff(at)), minlength=len(counts))
                    counts += found
                    if order == 1:
                        counts[BUCKETS:] += found[:-BUCKETS]
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    own = rows.where(F.col("lang").isin(languages)) if None in per_lang else rows
    sums = in_batches(own.select("text", "lang")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * 2 * BUCKETS)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    counts, chars = counts.reshape(len(languages), 2, BUCKETS).swapaxes(0, 1)
    counts = counts + SMOOTHING
    p = counts / counts.sum(axis=1, keepdims=True)
    logs = np.log(p)
    cross = p @ logs.T  # mean log probability of one language's n-grams under another
    np.fill_diagonal(cross, -np.inf)
    odds = logs - logs[cross.argmax(axis=1)]
    deviation = np.sqrt(np.maximum((p * odds**2).sum(axis=1) - (p * odds).sum(axis=1) ** 2, 0))
    own = len(ORDERS) * (p * logs).sum(axis=1)  # a character begins as many n-grams
    apart = own - len(ORDERS) * cross.max(axis=1) if len(languages) > 1 else np.ones(1)
    spread = len(ORDERS) * deviation / np.maximum(apart, 1e-9) if len(languages) > 1 else np.ones(1)
    order = np.log(len(ORDERS))
    varied = len(ORDERS) * np.sqrt(2 * np.maximum((p * logs**2).sum(axis=1) - (p * logs).sum(axis=1) ** 2, 0))
    ordered = own + len(ORDERS) * order - sum(ORDERS) * ((chars * logs).sum(axis=1) / np.maximum(chars.sum(axis=1), 1) + order)
    docs = np.array([per_lang[x] for x in languages], float)
    return Model(languages, np.log(docs / sum(per_lang.values())), logs.T.astype(np.float32).copy(), apart, ordered, spread, varied / np.maximum(ordered, 1e-9), (chars >= USED * np.maximum(chars.sum(axis=1, keepdims=True), 1)).any(axis=0))


def _strange(model: Model, chars: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many letters of each text no language of the block uses."""
    places = np.flatnonzero(~model.used[buckets])
    letters = np.array([chr(c).isalpha() for c in chars[places].tolist()], bool)
    return np.diff(np.searchsorted(places[letters], at))


def log_scores(model: Model, texts: pa.Array, mask: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log of prior times likelihood for each language, one row a text; the same for its characters drawn one by one; lengths in characters; strange letters."""
    strange = np.zeros(len(texts))
    out, noise, sizes = np.empty((len(texts), len(model.languages))), np.empty((len(texts), len(model.languages))), np.empty(len(texts), np.int64)
    for first, chars, begins in _chunks(_prose(texts, mask)):
        sums, n = np.zeros((len(ORDERS), len(begins) - 1, len(model.languages))), np.zeros((len(ORDERS), len(begins) - 1, 1))
        for k, (b, at) in enumerate(_grams(chars, begins)):
            if k == 0:
                strange[first : first + len(begins) - 1] = _strange(model, chars, b, at)
            some = np.diff(at) > 0
            n[k, :, 0] = np.diff(at)
            if len(chars) > CHUNK_CHARS:  # one long text: its counts by bucket take no more memory than a short one's
                sums[k, 0] = np.bincount(b, minlength=BUCKETS) @ model.weights
            elif some.any():
                sums[k, some] = np.add.reduceat(model.weights[b], at[:-1][some], axis=0, dtype=np.float64)
        last = first + len(begins) - 1
        out[first:last], sizes[first:last] = model.prior + sums.sum(axis=0), np.diff(begins)
        # a probability is that of the order times that of the n-gram among those of its order
        order = np.log(len(ORDERS))
        slots = np.tensordot(np.array(ORDERS, float), n, 1)  # characters in all n-grams
        noise[first:last] = model.prior - n.sum(axis=0) * order + slots / n[0] * (sums[0] + n[0] * order)
    return out, noise, sizes, strange


_FOUND = ("best", "log_best", "log_next", "log_all", "log_noise", "apart", "ordered", "spread", "noise_spread", "strange", "size")  # what a text carries from block to block


def _merged(model: Model, texts: pa.Array, before: list[pa.Array] | None, mask: str | None) -> list[pa.Array]:
    """The columns of _FOUND after this block of languages; the size is 0 where the mask has left no letter."""
    logs, noise, sizes, strange = log_scores(model, texts, mask)
    sizes = np.where([bool(_LETTER.search(t or "")) for t in _prose(texts, mask)], sizes, 0)
    rows, k = np.arange(len(texts)), logs.argmax(axis=1)
    best = np.array(model.languages, object)[k]
    top, noise, apart, ordered, spread, noise_spread = logs[rows, k], noise[rows, k], model.apart[k], model.ordered[k], model.spread[k], model.noise_spread[k]
    logs[rows, k] = -np.inf
    following = logs.max(axis=1)
    total = top + np.log1p(np.exp(logs - top[:, None]).sum(axis=1))
    if before is not None:
        old_best, old_top, old_next, old_all, *old_rest, old_strange, _ = (c.to_numpy(zero_copy_only=False) for c in before)
        following = np.maximum(np.minimum(top, old_top), np.maximum(following, old_next))
        earlier = old_top >= top  # of equally likely languages the first one holds
        best, noise, apart, ordered, spread, noise_spread = (
            np.where(earlier, old, new) for old, new in zip((old_best, *old_rest), (best, noise, apart, ordered, spread, noise_spread), strict=True))
        top, total, strange = np.maximum(top, old_top), np.logaddexp(total, old_all), np.minimum(strange, old_strange)
    return [pa.array(best, pa.string()), *(pa.array(c.astype(float)) for c in (top, following, total, noise, apart, ordered, spread, noise_spread, strange)), pa.array(sizes.astype(np.int64))]


def predict(docs: DataFrame, is_training: Column, pred_col: str = "lang_pred", score_col: str = "score", fit_col: str | None = None, slack: float = 0.0,
            mask: str | None = None) -> DataFrame:
    """The rows of ``docs`` (text, lang and others) with ``pred_col`` and ``score_col``, learnt from rows where ``is_training`` holds and lang is not null.

    The prediction is ``und`` with score 0 where a text is null or has no letter, or where nothing could be learnt. Else it is
    the likeliest learned language (the first in alphabetical order of equally likely ones) and its probability. With
    ``fit_col``, that column has the text's fit with ``slack`` standard errors for its length (0 for ``und``, and where ``mask``, a regular
    expression for what is neither learnt from nor scored, leaves no letter). Columns of these names in ``docs`` are replaced; a null ``is_training`` is not training; repeated rows count each; texts of
    any length count whole; an empty table gives no rows. The number of languages has no bound.
    """
    outs = [pred_col, score_col, *([fit_col] if fit_col else [])]
    docs = docs.drop(*outs)
    columns = docs.columns
    rows = docs.where(is_training & F.col("lang").isNotNull()).select("text", "lang")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    names, n_rows = sorted(per_lang), sum(per_lang.values())
    if not names:
        return docs.withColumns({pred_col: F.lit("und"), score_col: F.lit(0.0)} | ({fit_col: F.lit(0.0)} if fit_col else {}))
    held = free(docs, *_FOUND)
    zero = dict(zip(held, (F.lit(""), *[F.lit(0.0)] * 9, F.lit(0).cast("long")), strict=True))
    for lo, block in enumerate(np.array_split(np.array(names, object), -(-len(names) // LANGUAGES_AT_ONCE))):
        block = {x: per_lang[x] for x in block}
        if len(block) < len(names):
            block[None] = n_rows - sum(block.values())
        shared = docs.sparkSession.sparkContext.broadcast(train(rows, block, mask))

        def run(batches, shared=shared, first=lo == 0):
            for batch in batches:
                before = None if first else [batch.column(c) for c in held]
                found = _merged(shared.value, batch.column("text"), before, mask)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, *held])

        docs = in_batches(docs).mapInArrow(run, docs.select(columns).withColumns(zero).schema)
    best, top, following, total, noise, apart, ordered, spread, noise_spread, strange, size = (F.col(c) for c in held)
    # a letter in the sense of Unicode; accents may be marks of their own
    told = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    share = lambda rival, mean, error: F.when(mean > 0, (top - rival) / size / mean + slack * error / F.sqrt(size)).otherwise(0.0)
    against_noise = share(noise, ordered, noise_spread)
    fit = F.when(F.lit(len(names) == 1), against_noise).otherwise(F.least(share(following, apart, spread), against_noise))
    fit = F.when(~told | (size == 0), 0.0).otherwise(fit - strange / size)
    made = {pred_col: F.when(told, best).otherwise("und"), score_col: F.when(told, F.exp(top - total)).otherwise(0.0)} | ({fit_col: fit} if fit_col else {})
    return docs.withColumns(made).select(*columns, *outs)
