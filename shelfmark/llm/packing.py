"""Packing documents into sequences of a fixed capacity by bulk-synchronous best fit.

Documents and gaps (the space left in sequences) are range-sorted by size on one line. In a superstep every gap takes the
largest document that fits it and that no nearer gap takes: on the sorted line, a document is an opening bracket, a gap a
closing one, and brackets that belong together are a match. Each part of the line is swept on its own; what a part leaves
over is ranked by its depth in the whole line, from two counts a part, and ranks that meet are a match as well. Then the
gaps are updated and the superstep is repeated. A gap of several times the largest document left stands on the line as
several slots. When hardly any document found a gap, new sequences are opened for those that are left.

Once documents and gaps are few enough for one task (``ROWS_AT_ONCE``), the same supersteps go on inside it. The driver
sees counts of rows and the sum of what is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import bpe
from shelfmark.llm.storage import drop, free, in_batches, written

ROWS_AT_ONCE = 50_000  # documents and gaps that one task finishes on its own
ROWS_IN_A_PART = 2_000_000  # at most, where there are more of them than shuffle partitions
HARDLY_ANY = 64  # new sequences are opened once fewer than one in so many documents found a gap


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 2) -> DataFrame:
    """Encodes all texts and cuts those of more than ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    The first piece of a long document takes what is left over, all others are full. A null text is the end id alone.
    """
    def run(batches):
        for batch in batches:
            for first, ids, begins in bpe.encoded(batch.column("text"), path, end_id):
                sizes = np.diff(begins)
                n = -(-sizes // capacity)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rest = np.repeat(sizes - (n - 1) * capacity, n)
                start = np.where(piece == 0, 0, rest + (piece - 1) * capacity)
                length = np.where(piece == 0, rest, capacity)
                at = np.repeat(begins[:-1], n) + start
                crc = [zlib.crc32(ids[a : a + m].astype("<u4").tobytes()) for a, m in zip(at, length, strict=True)]
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(n)).take(owner), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")



def depth(is_gap: np.ndarray, before: int = 0) -> np.ndarray:
    """The depth of each bracket of a sorted line, which begins at depth ``before``; a document and the next gap of its depth belong together."""
    after = before + np.cumsum(np.where(is_gap, -1, 1))
    return after + is_gap


def sweep(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a line sorted by size, documents before gaps of their size: places of matched documents, and those of their gaps."""
    level = depth(is_gap)
    order = np.argsort(level, kind="stable")
    here, there = order[:-1], order[1:]
    pair = (level[here] == level[there]) & ~is_gap[here] & is_gap[there]
    return here[pair], there[pair]


def slots(space: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(gap, space) of the slots that gaps are cut into, each with space for a document of size ``largest``, or one for a gap of less than two of them."""
    n = np.maximum(space // max(largest, 1), 1)
    gap = np.repeat(np.arange(len(space)), n)
    place = np.arange(len(gap)) - np.repeat(np.cumsum(n) - n, n)
    each = np.repeat(space // n, n)
    return gap, np.where(place == 0, np.repeat(space, n) - each * (np.repeat(n, n) - 1), each)


def finish(sizes: np.ndarray, spaces: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """All supersteps of documents and gaps that one task holds: the gap of each document (numbers past ``spaces`` are new sequences), and how many are new."""
    found, left, n_old = np.full(len(sizes), -1), np.argsort(sizes, kind="stable"), len(spaces)
    while len(left):
        useful = np.flatnonzero(spaces >= sizes[left[0]])
        gap, space = slots(spaces[useful], int(sizes[left[-1]]))
        line = np.concatenate([sizes[left], space])
        is_gap = np.arange(len(line)) >= len(left)
        order = np.lexsort((is_gap, line))
        a, b = sweep(line[order], is_gap[order])
        docs, gaps = left[order[a]], useful[gap[order[b] - len(left)]]
        found[docs] = gaps
        np.subtract.at(spaces, gaps, sizes[docs])
        if len(docs) * HARDLY_ANY < len(left):
            rest = int(sizes[left].sum() - sizes[docs].sum())
            spaces = np.concatenate([spaces, np.full(-(-rest // capacity), capacity)])
        left = left[found[left] < 0]
    return found, len(spaces) - n_old





def _superstep(line: DataFrame, n_parts: int) -> DataFrame:
    """Rows (id, size, is_gap) to matches (doc, gap, size)."""
    keys = ["size", "is_gap", "id"]
    ordered = line.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        size, is_gap, ids = table["size"].to_numpy(), table["is_gap"].to_numpy(), table["id"].to_numpy()
        docs, gaps = sweep(size, is_gap)
        over = np.ones(len(size), bool)
        over[docs] = over[gaps] = False
        over = np.flatnonzero(over)  # gaps first, then documents
        part = TaskContext.get().partitionId()
        none = pa.nulls(len(over), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(docs), part, np.int32)), pa.array(ids[docs]), pa.array(ids[gaps]), pa.array(size[docs]), pa.nulls(len(docs), pa.int64())],
            ["part", "doc", "gap", "size", "place"])
        doc, gap = pa.array(ids[over], mask=is_gap[over]), pa.array(ids[over], mask=~is_gap[over])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(over), part, np.int32)), doc, gap, pa.array(size[over]) if len(over) else none, pa.array(np.arange(len(over)))],
                                         ["part", "doc", "gap", "size", "place"])

    swept = written(ordered.mapInArrow(run, "part int, doc long, gap long, size long, place long"), "swept")
    near = swept.where("place IS NULL").select("doc", "gap", "size")
    over = swept.where("place IS NOT NULL")
    # what the parts left over: gaps then documents in each, so two numbers a part tell the depth of every row in the whole line
    parts = over.groupBy("part").agg(F.count("gap").alias("gaps"), F.count("doc").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "gaps", F.coalesce(F.sum(F.col("docs") - F.col("gaps")).over(before), F.lit(0)).alias("before"))
    place = F.col("place") + 1
    level = F.when(F.col("gap").isNotNull(), F.col("before") - place + 1).otherwise(F.col("before") + place - 2 * F.col("gaps"))
    ranked = over.join(F.broadcast(parts), "part").withColumn("level", level)  # one row a part
    along = Window.partitionBy("level").orderBy("part", F.col("gap").isNull())
    following = ranked.select("doc", "size", F.when(F.col("doc").isNotNull(), F.lead("gap").over(along)).alias("gap"))
    matches = written(near.unionByName(following.where("gap IS NOT NULL").select("doc", "gap", "size")), "matches")
    drop(swept)
    return matches


def _slots(gaps: DataFrame, largest: int) -> DataFrame:
    n = F.greatest(F.floor(F.col("space") / largest), F.lit(1))
    each = F.floor(F.col("space") / n)
    return gaps.select("id", F.posexplode(F.array_repeat(each, n.cast("int"))).alias("place", "each"), "space", n.alias("n")).select(
        "id", F.when(F.col("place") == 0, F.col("space") - F.col("each") * (F.col("n") - 1)).otherwise(F.col("each")).alias("size"), F.lit(True).alias("is_gap"))


def _finished(docs: DataFrame, gaps: DataFrame, capacity: int, first_new: int) -> DataFrame:
    """Matches of a line that one task holds; new sequences are numbered downwards from ``first_new``."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("is_gap", "ascending"), ("size", "ascending"), ("id", "ascending")])
        is_gap, size, ids = (table[c].to_numpy() for c in ("is_gap", "size", "id"))
        found, n_new = finish(size[~is_gap], size[is_gap].copy(), capacity)
        names = np.concatenate([ids[is_gap], first_new - np.arange(n_new)])
        return pa.table({"doc": ids[~is_gap], "gap": names[found], "size": size[~is_gap]})

    both = docs.select("id", "size", F.lit(False).alias("is_gap")).unionByName(gaps.select("id", F.col("space").alias("size"), F.lit(True).alias("is_gap")))
    return both.groupBy().applyInArrow(run, "doc long, gap long, size long")


def _matches(docs: DataFrame, gaps: DataFrame, capacity: int) -> list[DataFrame]:
    """(doc, gap, size) for all of ``docs`` (id, size): tables of matches with ``gaps`` (id, space) and with new sequences, whose ids are below zero."""
    spark = docs.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, old, first_new = [], [], -1
    while True:
        n, total, least, largest = docs.agg(F.count(F.lit(1)), F.sum("size"), F.min("size"), F.max("size")).first()
        if not n:
            return found
        gaps = gaps.where(F.col("space") >= least)
        n_gaps = gaps.count()
        if n + n_gaps <= ROWS_AT_ONCE:
            return [*found, _finished(docs, gaps, capacity, first_new)]
        line = docs.select("id", "size", F.lit(False).alias("is_gap")).unionByName(_slots(gaps, largest))
        step = _superstep(line, int(max(min(most, -(-(n + n_gaps) // ROWS_AT_ONCE)), -(-(n + n_gaps) // ROWS_IN_A_PART))))
        found.append(step)
        placed, n_placed = step.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        filled = gaps.join(step.groupBy(F.col("gap").alias("id")).agg(F.sum("size").alias("taken")), "id", "left")
        filled = filled.select("id", (F.col("space") - F.coalesce("taken", F.lit(0))).alias("space"))
        if n_placed * HARDLY_ANY < n:
            n_new = -(-(total - placed) // capacity)
            filled = filled.unionByName(spark.range(n_new).select((F.lit(first_new) - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("space")))
            first_new -= n_new
        docs, old = written(docs.join(step.select(F.col("doc").alias("id")), "id", "left_anti"), "docs"), [*old, docs]
        gaps, old = written(filled.where("space > 0"), "gaps"), [*old, gaps]
        for table in old[2:] if len(old) > 2 else []:  # the first two are the caller's
            drop(table)
        old = old[:2]


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with doc_id, piece, and length from 1 to ``capacity``) plus sequence_id and offset.

    A piece of more than half the capacity opens a sequence of its own, which no other such piece could share. Pieces of
    one length go by doc_id and piece, null ids first. A null length, or one outside the range, is an error. Columns of
    ``pieces`` named sequence_id and offset are replaced, all others kept. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    number, doc, gap, size = free(pieces, "_number", "doc", "gap", "size")
    checked = pieces.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("no length from 1 to the capacity: "), F.coalesce(F.col("length").cast("string"), F.lit("null"))))).cast("long"))
    held = written(checked.withColumn(number, F.monotonically_increasing_id()), "pieces")
    own = F.col("length") * 2 > capacity
    docs = held.where(~own).select(F.col(number).alias("id"), F.col("length").alias("size"))
    gaps = held.where(own & (F.col("length") < capacity)).select(F.col(number).alias("id"), (F.lit(capacity) - F.col("length")).alias("space"))
    matches = held.sparkSession.createDataFrame([], "doc long, gap long, size long")
    for found in _matches(docs, gaps, capacity):
        matches = matches.unionByName(found)
    matches = matches.select(F.col("doc").alias(doc), F.col("gap").alias(gap))
    placed = held.join(matches, F.col(number) == F.col(doc), "left").withColumn("sequence_id", F.coalesce(gap, number))
    # a sequence holds at most ``capacity`` pieces
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", number).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop(number, doc, gap)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """All texts of ``docs`` (doc_id, text) as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; null ids and repeated rows are documents like any other; other columns
    are left out; an empty table gives no rows.
    """
    return best_fit(written(token_pieces(docs, path, capacity, end_id), "tokens"), capacity)
