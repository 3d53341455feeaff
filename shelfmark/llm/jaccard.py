"""Similarity join of texts by the Jaccard index of their word n-gram sets, by a blocked sparse matrix product.

Documents by n-grams is a sparse 0/1 matrix A, and A times its transpose holds every overlap. The product is never
taken whole:

1. Rows with equal sets are one class, and one row of it stands for all.
2. Size-derived bound on columns. Partners of x at threshold t hold at least ceil(t |x|) of its n-grams, so x misses at
   most s(x) = |x| - ceil(t |x|). Of the first s(x) + l(x) n-grams of x in hash order, at least l are among the same
   first ones of each partner. Rows with fewer n-grams there that any other row has as well can have no partner.
3. For the rows left, the order of n-grams is by how many rows have them, then by hash; partners share one of the first
   s(x) + 1. Rows that share none directly or through others are in different groups, so A falls into diagonal blocks.
4. Each group's product is sparse: a row adds up, over its n-grams, the rows of the n-gram's column. Rows are in the
   order of their sizes, so only a stretch of them can reach the bound that the two sizes give; overlaps below it are
   dropped, and what is left are the links. A group of more than ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` is cut into row
   blocks, and a second round only compares what the first has not joined, band by band of sizes that can link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words
from shelfmark.llm.components import connected
from shelfmark.llm.skew import join_counted
from shelfmark.llm.storage import drop, free, in_batches, written

BLOCK_ROWS = 256  # rows of one block of a large group
BROADCAST_ROWS = 1_000_000  # up to so many picked rows (24 bytes each) are broadcast to pick their texts; more are joined by a shuffle
BLOCK_BYTES = 4 << 20  # of n-grams of one block, on average


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, all sets one after the other as sorted distinct hashes, where each begins)."""
    for first, _, data, offsets in words.chunks(column):
        h, begins = words.shingles(*words.word_hashes(data, offsets), k)
        doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield first, h, np.searchsorted(doc, np.arange(len(begins)))


def slack(n, percent: int):
    """How many n-grams of a set of n a partner can lack: n - ceil(n percent / 100)."""
    return n - (n * percent + 99) // 100


def _long_list(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))


def _signature(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set that equal sets share."""
    n = np.diff(begins)
    sig = np.zeros((2, len(n)), np.uint64)
    if len(h):
        for i, salt in enumerate((0x51ED270B, 0xB492B66F)):
            sig[i, n > 0] = np.add.reduceat(words.mix(h ^ words.U(salt)), begins[:-1][n > 0])
    return words.mix(sig + n.astype(np.uint64)).view(np.int64)


def _signed(docs: DataFrame, k: int, percent: int, carry: list[str]) -> DataFrame:
    """doc_id, the columns to carry along, n_shingles, the set's signature, and its first n-grams in hash order (see step 2)."""
    def run(batches):
        for batch in batches:
            for first, h, begins in _sets(batch.column("text"), k):
                n = np.diff(begins)
                first_ones = np.minimum(n, 2 * slack(n, percent) + 1)
                keep = np.arange(len(h)) - np.repeat(begins[:-1], n) < np.repeat(first_ones, n)
                sig = _signature(h, begins)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(n)) for c in ["doc_id", *carry]), pa.array(n.astype(np.int32)), pa.array(sig[0]), pa.array(sig[1]),
                     _long_list(h[keep], np.concatenate([[0], np.cumsum(first_ones)]))],
                    ["doc_id", *carry, "n_shingles", "sig_a", "sig_b", "firsts"])

    kept = docs.select("doc_id", *carry, "text")
    zero = {c: F.lit(0).cast(kind) for c, kind in (("n_shingles", "int"), ("sig_a", "long"), ("sig_b", "long"))}
    return in_batches(kept).mapInArrow(run, kept.drop("text").withColumns(zero | {"firsts": F.array(F.lit(0).cast("long"))}).schema)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, h, begins in _sets(batch.column("text"), k):
                sig = _signature(h, begins)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(begins) - 1), pa.array(sig[0]), pa.array(sig[1]), _long_list(h, begins)],
                                                 ["node", "sig_a", "sig_b", "grams"])

    return in_batches(docs.select("node", "text")).mapInArrow(run, "node long, sig_a long, sig_b long, grams array<long>")


def _block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` (indices into ``sets``) that join all labels that links join, and no more than that takes."""
    sizes = np.array([len(s) for s in sets])
    left, right = (x[np.argsort(sizes[x], kind="stable")] for x in (left, right))
    # the columns of the incidence matrix: for each n-gram, the places in ``right`` of the rows that have it
    values, column = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    place = np.repeat(np.arange(len(right), dtype=np.int32), sizes[right])
    rows, begins = place[np.argsort(column, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(values)))])
    del place, column
    now = np.unique(label, return_inverse=True)[1]  # the part that each row is in
    found = []
    for i in left:
        n = sizes[i]
        lo, hi = np.searchsorted(sizes[right], [-(-n * percent // 100), n * 100 // percent + 1])
        if (now[right[lo:hi]] == now[i]).all():
            continue
        at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
        at = at[values[at] == sets[i]]
        count = begins[at + 1] - begins[at]
        here = rows[np.arange(count.sum()) + np.repeat(begins[at] - np.cumsum(count) + count, count)]
        overlap = np.bincount(here, minlength=len(right))[lo:hi]
        linked = right[lo:hi][100 * overlap >= percent * (n + sizes[right[lo:hi]] - overlap)]
        for j in linked:
            if now[i] != now[j]:
                now[now == now[j]] = now[i]
                found.append((int(i), int(j)))
    return found


def _links(rows: DataFrame, keys: list[str], n_tasks: int, percent: int) -> DataFrame:
    """Links (a, b) found inside each group of ``keys``: between its rows of side 0 and those of side 1, or among all where there is no side 1."""
    def product(table: pa.Table) -> pa.Table:
        node, label, side = (table[c].to_numpy() for c in ("node", "label", "side"))
        grams = table["grams"].combine_chunks()
        sets = [s.view(np.uint64) for s in np.split(grams.flatten().to_numpy(), grams.offsets.to_numpy()[1:-1] - grams.offsets[0].as_py())]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        found = _block_links(sets, left, right, label, percent) if len(left) else []
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return rows.select(*keys, "node", "label", "side", "grams").repartition(n_tasks, *keys).groupBy(*keys).applyInArrow(product, "a long, b long")


def _components(docs: DataFrame, k: int, percent: int, n_tasks: int | None, carry: list[str]) -> DataFrame:
    """doc_id, ``carry``, n_shingles, component (a number; null without shingles), component_id, one row for each of ``docs``."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    spark = docs.sparkSession
    n_tasks = n_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # 1. equal sets have one signature; `node` is a number for it
    sig = ["sig_a", "sig_b"]
    node = F.xxhash64(*sig)
    firsts = written(_signed(docs, k, percent, carry), "firsts")
    signed = written(firsts.drop("firsts"), "signed")
    classes = written(signed.where("n_shingles > 0").groupBy(*sig).agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").cast("long").alias("n"), F.count(F.lit(1)).alias("copies")).withColumn("node", node), "classes")
    # 2. rows that can have a partner: of their first n-grams, those of no other set are counted
    owners = firsts.select(node.alias("node"), F.explode("firsts").alias("gram")).groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    lone = owners.where("lo = hi").groupBy(F.col("lo").alias("node")).agg(F.count(F.lit(1)).alias("lone"))
    n = F.col("n")
    shared = F.least(n, 2 * slack_col(n, percent) + 1) - F.coalesce("lone", F.lit(0))
    need = 1 + slack_col(F.floor((n * percent + 99) / 100).cast("long"), percent)  # the smallest partner's l
    able = written(classes.join(lone, "node", "left").where(shared >= need).select("node", "n", "rep", *sig), "able")
    drop(firsts)
    # 3. whole sets of these rows, from their texts; groups by their rarest n-grams
    pick = able.select("node", F.col("rep").alias("doc_id"))
    if able.count() <= BROADCAST_ROWS:
        pick = F.broadcast(pick)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(pick, F.col("id").eqNullSafe(F.col("doc_id")))
    # an id may stand for several texts: the set's own signature tells which is meant
    sets = _full_sets(texts, k).where(F.col("node") == node)
    sets = written(sets.groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    cells = sets.select("node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    df = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("cells", F.col("df"))
    df = written(df, "frequencies")
    ranked = join_counted(cells, df, ["gram"], "cells").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    # n-grams that no other row has come first in the order, so they take up places of the first s(x) + 1
    places = slack_col(n, percent) + 1 - (n - F.size("shared"))
    rarest = ranked.where(places > 0).select("node", F.explode(F.slice("shared", F.lit(1), places.cast("int"))).alias("x")).select("node", F.col("x.gram").alias("gram"))
    rarest = written(rarest, "rarest")
    hub = written(rarest.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1"), "hubs")
    groups = connected(join_counted(rarest, hub, ["gram"], "df").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    groups = groups.withColumnRenamed("component", "grp")
    # 4. the product of each group
    rows = written(sets.join(groups, "node").withColumn("n", F.size("grams")), "rows")
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), (F.sum("n") * 8).alias("bytes")).withColumn("rows", F.col("size"))
    size = written(size, "sizes")
    links = _product(join_counted(rows, size, ["grp"], "rows"), n_tasks, percent)
    for table in (df, rarest, hub):
        drop(table)
    joined = connected(links)
    # every row gets its component's smallest id
    ids = written(classes.select("node", "rep", "copies", *sig).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "ids")
    smallest = ids.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    by_set = written(join_counted(ids, written(smallest, "smallest"), ["component"], "rows").select(*sig, "component", "component_id", "copies"), "by_set")
    shown = lambda component, component_id: ["doc_id", *carry, F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component"), component_id.alias("component_id")]
    some = join_counted(signed.where("n_shingles > 0"), by_set, sig, "copies").select(shown(F.col("component"), F.col("component_id")))
    return some.unionByName(signed.where("n_shingles = 0").select(shown(F.lit(None).cast("long"), F.col("doc_id"))))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, n_tasks: int | None = None) -> DataFrame:
    """Components of the texts of ``docs`` (doc_id, text) under links of Jaccard index >= percent / 100 over distinct k-word shingles.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Returns one row for each row of
    ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included). A text of fewer than
    k words has its whole sequence as the only shingle; null or empty texts and texts of white space have none, link
    with nothing and are their own component. Rows that repeat an id count one by one and share its component if their
    texts are equal; null ids stay null rows, and a component of null ids only has a null id. Other columns are left out.
    Shingles are compared by 64-bit hashes, sets for equality by 128 bits.
    """
    return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent, n_tasks, []).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, n_tasks: int | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id, a null id last, then by a hash of the text.

    Texts without words are in no component and stay. All columns are kept, whatever their names.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = written(_components(keyed, k, percent, n_tasks, ["text_hash"]), "components")
    id_, hash_ = free(docs, "_id", "_hash")
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_hash")
    first = written(named(first.unionByName(found.where("n_shingles = 0").select("doc_id", "text_hash").distinct())), "first")
    side = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    kept = docs.join(side, same, "left_semi")
    # rows that repeat an id and a text are one document's copies; there are none where ids are unique
    twins = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = written(named(twins), "twins")
    if twins.isEmpty():
        return kept
    return kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def slack_col(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("long")


def _n_blocks(size: Column, n_bytes: Column) -> Column:
    return F.ceil(F.greatest(size / BLOCK_ROWS, n_bytes / BLOCK_BYTES)).cast("int")


def _product(rows: DataFrame, n_tasks: int, percent: int) -> DataFrame:
    """Links (a, b) that join all linked rows of each group of ``rows`` (node, grams, n, grp, size, bytes)."""
    rows = rows.withColumn("label", F.col("node")).withColumn("side", F.lit(0)).withColumn("n_blocks", _n_blocks(F.col("size"), F.col("bytes")))
    small = _links(rows.where("n_blocks = 1"), ["grp"], n_tasks, percent)
    large = rows.where("n_blocks > 1").withColumn("block", F.pmod(F.hash("node"), "n_blocks"))
    # round one: each block against itself and the next one
    near = large.withColumn("at", F.explode(F.array(F.col("block"), F.pmod(F.col("block") + 1, "n_blocks"))))
    first = written(small.unionByName(_links(near, ["grp", "at"], n_tasks, percent)), "links")
    return first if large.isEmpty() else first.unionByName(_rest(large, first, n_tasks, percent))


def band_of(n: Column, percent: int) -> Column:
    """A number that differs by one at most between sizes that can link."""
    if percent == 100:
        return n.cast("int")
    return F.floor(F.log(n) / (np.log(100 / percent) * (1 + 1e-9))).cast("int")


def _rest(large: DataFrame, first: DataFrame, n_tasks: int, percent: int) -> DataFrame:
    """Round two: rows outside their group's largest part against the rows of the group in bands of sizes that can link, in pairs of blocks."""
    parts = connected(first)
    labelled = large.drop("label", "side", "block", "n_blocks", "size", "bytes").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = written(labelled.withColumn("band", band_of(F.col("n"), percent)), "labelled")
    count = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
    main = count.groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("rows"))
    labelled = written(join_counted(labelled, written(main, "main"), ["grp"], "rows").where("parts > 1"), "apart")
    apart = labelled.where("label <> main")
    # of each band: how many rows are apart in it, and how many rows there are in it and the two beside it
    own = labelled.groupBy("grp", "band").agg(F.count_if(F.col("label") != F.col("main")).alias("n_apart"), F.count(F.lit(1)).alias("k"), (F.sum("n") * 8).alias("bytes"))
    beside = own.select("grp", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"), "k", "bytes").groupBy("grp", "band").agg(F.sum("k").alias("k"), F.sum("bytes").alias("bytes"))
    mean = F.col("bytes") / F.col("k")
    bands = own.where("n_apart > 0").select("grp", "band", "n_apart").join(beside, ["grp", "band"]).select(
        "grp", "band", _n_blocks(F.col("n_apart"), F.col("n_apart") * mean).alias("n_sb"), _n_blocks(F.col("k"), F.col("bytes")).alias("n_b"), F.col("n_apart"), "k")
    bands = written(bands, "bands")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_counted(apart, bands.drop("k"), ["grp", "band"], "n_apart").withColumn("sb", F.pmod(F.hash("node", F.lit(7)), "n_sb")).withColumn("block", every("n_b")).withColumn("side", F.lit(0))
    near = labelled.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    right = join_counted(near, bands.drop("n_apart"), ["grp", "band"], "k").withColumn("block", F.pmod(F.hash("node"), "n_b")).withColumn("sb", every("n_sb")).withColumn("side", F.lit(1))
    cols = ["grp", "band", "sb", "block", "node", "label", "side", "grams"]
    return _links(left.select(*cols).unionByName(right.select(*cols)), cols[:4], n_tasks, percent)
