"""Hidden Markov language model, trained by Baum-Welch over the whole training corpus.

Words are symbols of a bounded alphabet: the most frequent training words have a symbol each, all others share
``RARE_SYMBOLS`` buckets by hash, and inside a bucket a word has the add-one share of its training count (one more share
stands for all words never seen). A text's probability is the probability of its symbols under the hidden Markov model,
by the scaled forward recursion over the whole text, times the shares.

Each Baum-Welch iteration is one pass: tasks run forward-backward over their whole texts and give expected counts, Spark
adds them up (as whole numbers, so in any order alike), and the driver makes the next model from them: STATES * (STATES +
symbols) numbers, whatever the corpus. A long text is gone through in stretches: the forward pass keeps the state vector
before each, and the backward pass runs each stretch forward again, so counts are exact in bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words
from shelfmark.llm.storage import in_batches, written

STATES = 8
FREQUENT_WORDS = 6144  # words with a symbol of their own
RARE_SYMBOLS = 2048  # a power of two
KNOWN_WORDS = 1 << 18  # at most so many words have their counts looked up in tasks; counts of all others come by a join
BINS = 4096  # of a histogram of counts
ITERATIONS = 4
TOKENS_AT_ONCE = 200_000  # tokens whose state vectors a task holds
UNIT = 1 << 16  # expected counts are added up in units of 1 / UNIT
END = np.uint64(0x1D8E4E27C47D124F)  # the hash of the end token
MASS = 0.01  # added to each expected emission and transition count


def tokens(column: pa.Array):
    """(first row, word hashes with an end token after each text, where each text begins) of runs of texts."""
    for first, _, data, offsets in words.chunks(column):
        h, begins = words.word_hashes(data, offsets)
        yield first, np.insert(h, begins[1:], END), begins + np.arange(len(begins))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all tokens of ``texts``, the end token among them; each task adds up its own words first."""
    def run(batches):
        held, n_held = [], 0

        def flush():
            w, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            u, at = np.unique(w, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, c).astype(np.int64))], ["word", "c"])

        for batch in batches:
            for _, h, _ in tokens(batch.column("text")):
                held.append(np.unique(h, return_counts=True))
                n_held += len(held[-1][0])
                if n_held > 2_000_000:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    return in_batches(texts.select("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of the training words: bounded by KNOWN_WORDS and RARE_SYMBOLS."""

    words: np.ndarray  # sorted
    counts: np.ndarray
    symbols: np.ndarray  # for each of ``words``
    n_own: int  # symbols below this one stand for one word
    n_symbols: int
    total: int
    distinct: int
    log_rare: np.ndarray  # log10 of a bucket's add-one mass

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each word; count -1 where tasks don't know it."""
        rare = (self.n_own + (h % words.U(RARE_SYMBOLS)).astype(np.int64)).astype(np.uint16)
        if not len(self.words):
            return rare, np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.where(hit, self.symbols[at], rare), np.where(hit, self.counts[at], -1)


def count_of_rank(counts: DataFrame, largest: int, rank: int) -> int:
    """The smallest count that ``rank`` words at most reach, from histograms of BINS counts, each of one bin of the one before."""
    low, width, above = 1, max(1, largest), 0  # counts of low to low + width - 1 are looked at; ``above`` words have more
    while True:
        step = -(-width // BINS)
        inside = counts.where(F.col("c").between(low, low + width - 1))
        bins = sorted(inside.groupBy(F.floor((F.col("c") - low) / step).alias("b")).count().collect(), reverse=True)
        for b, n in bins:
            if above + n > rank:
                if step == 1:
                    return low + b + 1
                low, width = low + b * step, step
                break
            above += n
        else:
            return low


def make_vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct, largest = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("c"), F.lit(0))).first()
    top = counts.where(F.col("c") >= count_of_rank(counts, largest, KNOWN_WORDS)).toArrow()  # a bounded number of 16-byte rows
    w, c = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    rank = np.lexsort((w.view(np.int64), -c))
    w, c = w[rank], c[rank]
    n_own = min(FREQUENT_WORDS, len(w))
    symbols = np.where(np.arange(len(w)) < n_own, np.arange(len(w)), n_own + (w % words.U(RARE_SYMBOLS)).astype(np.int64)).astype(np.uint16)
    # mass of each bucket over all words without a symbol: all buckets' sums less those of the words that have one
    bucket = F.col("word").bitwiseAND(RARE_SYMBOLS - 1)  # the unsigned remainder
    mass = np.zeros(RARE_SYMBOLS, np.int64)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["b"]] = r["m"]
    np.subtract.at(mass, (w[:n_own] % words.U(RARE_SYMBOLS)).astype(np.int64), c[:n_own] + 1)
    order = np.argsort(w)
    return Vocabulary(w[order], c[order], symbols[order], n_own, n_own + RARE_SYMBOLS, int(total), int(distinct), np.log10(mass + 1.0))


def encode(docs: DataFrame, vocabulary, key_cols: list[str]) -> DataFrame:
    """Each text as symbols, with what is known of its words' counts; words that tasks don't know are listed for the join.

    Columns: the keys, n_tokens, known (tokens with a known count), log_counts (sum of log10(c + 1) over those),
    log_own (the part of it of words with a symbol of their own), symbols (uint16 each), rest (other words).
    """
    def run(batches):
        voc = vocabulary.value
        for batch in batches:
            keys = [batch.column(c) for c in key_cols]
            for first, h, begins in tokens(batch.column("text")):
                n = len(begins) - 1
                symbol, c = voc.look_up(h)
                known = c >= 0
                logs = np.where(known, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                add = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731  no text is without a token
                rest_begins = np.concatenate([[0], np.cumsum(add((~known).astype(np.int64)))])
                yield pa.RecordBatch.from_arrays(
                    [*(k.slice(first, n) for k in keys), pa.array(np.diff(begins)), pa.array(add(known.astype(np.int64))), pa.array(add(logs)),
                     pa.array(add(np.where(symbol < voc.n_own, logs, 0.0))),
                     pa.array([symbol[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(rest_begins.astype(np.int32)), pa.array(h[~known].view(np.int64)))],
                    [*key_cols, "n_tokens", "known", "log_counts", "log_own", "symbols", "rest"])

    kept = docs.select(*key_cols, "text")
    schema = kept.drop("text").schema.simpleString()[7:-1].replace(":", " ")
    return in_batches(kept).mapInArrow(run, schema + ", n_tokens long, known long, log_counts double, log_own double, symbols binary, rest array<long>")


@dataclass
class Model:
    start: np.ndarray  # of a text, by state
    move: np.ndarray  # from state to state
    emit: np.ndarray  # symbol by state


def first_model(n_symbols: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.full(STATES, 2.0), n_symbols)
    move = 0.6 * np.eye(STATES) + 0.4 * rng.dirichlet(np.full(STATES, 5.0), STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def no_counts(n_symbols: int) -> list[np.ndarray]:
    """Expected starts, moves and emissions, and the log10 likelihood."""
    return [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n_symbols, STATES)), np.zeros(1)]


def expected_counts(model: Model, symbols: np.ndarray, begins: np.ndarray, counts: list[np.ndarray]) -> None:
    """Adds the expected counts of these texts, none of them empty, to ``counts``; texts go side by side, longest first."""
    order = np.argsort(-np.diff(begins), kind="stable")
    first, length = begins[:-1][order], np.diff(begins)[order]
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(steps + 1), "left")  # texts longer than t
    upto = np.concatenate([[0], np.cumsum(live)])
    cuts = [0]  # stretches of steps with TOKENS_AT_ONCE tokens in all
    while cuts[-1] < steps:
        cuts.append(max(cuts[-1] + 1, min(steps, int(np.searchsorted(upto, upto[cuts[-1]] + TOKENS_AT_ONCE, "right")) - 1)))
    one = np.ones(STATES, np.float32)

    def forward(lo: int, hi: int, before: np.ndarray | None, keep: bool):
        """State vectors of steps lo to hi - 1, emissions and scales; without ``keep``, the last step's state vectors alone."""
        a, b, scale = [], [], []
        for t in range(lo, hi):
            n = live[t]
            e = emit[symbols[first[:n] + t]]
            x = (start if t == 0 else before[:n] @ move) * e
            s = x @ one
            before = x / s[:, None]
            if keep:
                a.append(before)
                b.append(e)
                scale.append(s)
        return (a, b, scale) if keep else before

    entry = [None]
    for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
        entry.append(forward(lo, hi, entry[-1], keep=False))
    beta = np.ones((len(first), STATES), np.float32)
    ahead = None  # emission times beta over scale of the step after, of the texts that have one
    for k in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[k], cuts[k + 1]
        a, b, scale = forward(lo, hi, entry[k], keep=True)
        for t in range(hi - 1, lo - 1, -1):
            at, m = a[t - lo], live[t + 1]
            if m:
                counts[1] += model.move * (at[:m].T @ ahead)
                beta[:m] = ahead @ move.T
            n = live[t]
            ahead = b[t - lo] * beta[:n] / scale[t - lo][:, None]
            at *= beta[:n]  # now the posterior
        counts[3] += sum(float(np.log10(s).sum(dtype=np.float64)) for s in scale)
        sym = np.concatenate([symbols[first[: live[t]] + t] for t in range(lo, hi)])
        post = np.concatenate(a)
        for state in range(STATES):
            counts[2][:, state] += np.bincount(sym, post[:, state], minlength=len(counts[2]))
        if lo == 0:
            counts[0] += a[0].sum(axis=0)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("symbols").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] // 2 : offsets[-1] // 2], (offsets - offsets[0]) // 2


def train(encoded: DataFrame, n_symbols: int) -> tuple[Model, list[float]]:
    """The model after ITERATIONS passes over all texts, and the log10 likelihood of the texts before each."""
    spark, model, likelihoods = encoded.sparkSession, first_model(n_symbols), []
    for _ in range(ITERATIONS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            now, counts, some = shared.value, no_counts(n_symbols), False
            for batch in batches:
                symbols, begins = _sequences(batch)
                some = some or len(batch) > 0
                # texts of like length go together, as many as TOKENS_AT_ONCE allows
                order = np.argsort(-np.diff(begins), kind="stable")
                size = np.diff(begins)[order]
                upto, at = np.concatenate([[0], np.cumsum(size)]), 0
                while at < len(order):
                    to = max(at + 1, int(np.searchsorted(upto, upto[at] + TOKENS_AT_ONCE, "right")) - 1)
                    rows = order[at:to]
                    ends = np.cumsum(size[at:to])
                    here = np.arange(ends[-1]) + np.repeat(begins[rows] - ends + size[at:to], size[at:to])
                    expected_counts(now, symbols[here], np.concatenate([[0], ends]), counts)
                    at = to
            if some:
                flat = np.rint(np.concatenate([c.ravel() for c in counts]) * UNIT).astype(np.int64)
                cells = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(flat[cells])], ["cell", "n"])

        sums = in_batches(encoded.select("symbols")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(STATES + STATES * STATES + n_symbols * STATES + 1)
        flat[sums["cell"].to_numpy()] = sums["n"].to_numpy() / UNIT
        likelihoods.append(float(flat[-1]))
        start, move, emit = np.split(flat[:-1] + MASS, [STATES, STATES + STATES * STATES])
        move, emit = move.reshape(STATES, STATES), emit.reshape(n_symbols, STATES)
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.unpersist()
    return model, likelihoods


def log_likelihoods(model: Model, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """log10 of each text's probability: the forward recursion over its whole length, scaled at each step."""
    lengths = np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    first, length = begins[:-1][order], lengths[order]
    total = np.zeros(len(order))
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    one = np.ones(STATES)
    for t, n in enumerate(live):
        x = (model.start if t == 0 else a[:n] @ model.move) * model.emit[symbols[first[:n] + t]]
        s = x @ one
        total[:n] += np.log10(s)
        a = x / s[:, None]
    out = np.empty(len(order))
    out[order] = total
    return out


def _scored(encoded: DataFrame, model, vocabulary, keys: list[str]) -> DataFrame:
    def run(batches):
        now, voc = model.value, vocabulary.value
        off = np.concatenate([np.zeros(voc.n_own), voc.log_rare])
        for batch in batches:
            symbols, begins = _sequences(batch)
            out = log_likelihoods(now, symbols, begins) - np.add.reduceat(off[symbols], begins[:-1]) if len(batch) else np.zeros(0)
            rest = [batch.column(c) for c in (*keys, "n_tokens", "known", "log_counts", "log_own")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out)], [*keys, "n_tokens", "known", "log_counts", "log_own", "forward"])

    kept = encoded.select(*keys, "n_tokens", "known", "log_counts", "log_own", "symbols")
    schema = kept.drop("symbols").schema.simpleString()[7:-1].replace(":", " ")
    return in_batches(kept).mapInArrow(run, schema + ", forward double")


def score(docs: DataFrame, is_training) -> DataFrame:
    """Every text's log10 probability under a model learnt from the rows where ``is_training`` holds.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (this model). Tokens
    are runs of characters other than ASCII white space with A-Z lower-cased, then one end token; a null or empty text
    is the end token alone. Null ids, equal rows and very long texts are texts like any other, and each input row gives
    one row; rows where ``is_training`` is null are held out. An empty table, or one without training rows, is scored
    by a model that has seen nothing. Other columns are left out. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~F.coalesce(is_training, F.lit(False))).alias("held_out"))
    counts = written(word_counts(rows.where("NOT held_out")), "counts")
    voc = make_vocabulary(counts)
    shared = spark.sparkContext.broadcast(voc)
    encoded = written(encode(rows, shared, ["doc_id", "held_out"]).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = spark.sparkContext.broadcast(train(encoded.where("NOT held_out"), voc.n_symbols)[0])
    scored = _scored(encoded, model, shared, ["row", "doc_id", "held_out"])
    rest = encoded.where(F.size("rest") > 0).select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    joined = rest.join(counts, "word").groupBy("row").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero(F.col("more_known"))).cast("long").alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(voc.total + voc.distinct + 1)))).alias("base_score"),
        (F.col("forward") + logs - F.col("log_own")).alias("score"))
