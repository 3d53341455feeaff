"""Connected components of a graph given as edges, by local contraction: every node goes to the neighbour that a seeded hash puts first; a bounded rest is one task's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.skew import join_counted, most_rows
from shelfmark.llm.storage import drop, measured, written

EDGES_AT_ONCE = 50_000  # edges that one task finishes on its own


def _measured(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """A table with a count ``n`` in each row, written; the sum of the counts and the largest."""
    out, found = measured(df, name, total=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))
    return out, (found.get("total", 0), found.get("most", 0))


def _hops(left: DataFrame, seed: int) -> tuple[DataFrame, tuple[int, int]]:
    """Rows (node, to, n) for the nodes of ``left``: the first by hash of the node and its neighbours, and its number of edges."""
    both = left.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    rank = lambda c: F.xxhash64(F.lit(seed), c)
    near = both.groupBy("a").agg(F.min(rank("b")).alias("rank"), F.min_by("b", rank("b")).alias("first"), F.count(F.lit(1)).alias("n"))
    return _measured(near.select(F.col("a").alias("node"), F.when(F.col("rank") < rank("a"), F.col("first")).otherwise(F.col("a")).alias("to"), "n"), "hops")


def _contracted(left: DataFrame, hops: DataFrame, known: tuple[int, int]) -> tuple[DataFrame, int]:
    """The edges of ``left`` between what ``hops`` makes of their ends, without loops and repeats, and how many they are."""
    at = lambda end, to: hops.select(F.col("node").alias(end), F.col("to").alias(to), "n")
    ends = join_counted(left, at("a", "x"), ["a"], "n", known)
    hot = known[1] > most_rows(left, known[0])
    if hot:  # it is read twice
        ends = written(ends, "ends")
    moved = join_counted(ends, at("b", "y"), ["b"], "n", known).where("x <> y")
    out, found = measured(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges", n=F.count(F.lit(1)))
    if hot:
        drop(ends)
    return out, found.get("n", 0)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges from ``a`` to ``b``, and of each the smallest that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return nodes, nodes[np.array([root(x) for x in range(len(nodes))], np.int64)]


def _finished(left: DataFrame) -> DataFrame:
    """Rows (node, to) for the nodes of ``left``, EDGES_AT_ONCE edges at most: the smallest node that each is connected with."""
    def run(batches):
        table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        node, to = roots(table["a"].to_numpy(), table["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(to, pa.int64())], ["node", "to"])

    return written(left.select("a", "b").coalesce(1).mapInArrow(run, "node long, to long"), "finished")


def connected(edges: DataFrame) -> DataFrame:
    """Rows (a, b) of longs to rows (node, component): the smallest node that can be reached, for every node of an edge.

    Each round sends every node to the first of itself and its neighbours, by a hash with the round's own seed, and puts
    where they went in the edges' places. That keeps what is connected with what, and as no order of names matters, the
    nodes shrink by a constant factor a round on average (a half on a chain, more where nodes have more edges). Two
    jobs make a round; that edges are left, and how many edges a node has, is measured while tables are written, and
    is all that comes to the driver. A node with any number of edges, and a component of any size, fills no task. Once
    EDGES_AT_ONCE edges are left, however many there were, one task joins those, as each round more is two jobs here and
    two on the way back. Loops and repeated edges do no harm; null ends are dropped.
    """
    left, found = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n=F.count(F.lit(1)))
    n, rounds = found.get("n", 0), []
    while n > EDGES_AT_ONCE:
        hops, known = _hops(left, len(rounds))
        rest, n = _contracted(left, hops, known)
        rounds.append(hops)
        drop(left)
        left = rest
    if n:
        last = _finished(left)
        drop(left)
        if not rounds:
            return last.select("node", F.col("to").alias("component"))
    elif not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    else:
        last = rounds.pop()
    labels = last.select("node", F.col("to").alias("component"))
    for hops in reversed(rounds):  # where a node went may have gone on in later rounds
        went = hops.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        side, known = _measured(went.join(labels.withColumnRenamed("node", "to"), "to", "left").select("to", "n", F.coalesce("component", "to").alias("component")), "side")
        step = written(join_counted(hops.select("node", "to"), side, ["to"], "n", known).select("node", "component"), "labels")
        for table in (hops, side, labels):
            drop(table)
        labels = step
    least, known = _measured(labels.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    return join_counted(labels, least, ["component"], "n", known).select("node", F.col("least").alias("component"))
