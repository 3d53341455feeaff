"""Licence scans by diagonal voting.

Every run of k words of every document is hashed and joined with the runs of the templates. A run at word p of the
document and q of the template votes for the diagonal p - q; a passage that follows the template puts its votes on one
diagonal, and an inserted or dropped word moves the rest to a neighbouring one. Votes are added up by diagonal,
neighbouring diagonals are merged, and the spans found are held against the template: what share of its runs they hold,
and whether they are about as long. Runs that share a hash are compared word by word in the join, so no span rests on a
collision.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.storage import written
from shelfmark.llm.wordcols import CAPITALS, SMALL, WORD, words

MASK_BITS = 62  # of a template's runs that one whole number holds a bit of
# What licences ask to be said, as (label, text).
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    """The words of a template as ``wordcols.words`` finds them in a column."""
    return re.findall(WORD, text.translate(str.maketrans(CAPITALS, SMALL)))


def _templates(phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> list[tuple]:
    """(number, label, whether a phrase, words, width of its runs) of all that have words."""
    made = [(label, exact, template_words(text)) for exact, given in ((True, phrases), (False, notices)) for label, text in given]
    return [(i, label, exact, found, min(k, len(found))) for i, (label, exact, found) in enumerate(made) if found]


def _run_hash(array: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(array, at + j) for j in range(width)))


def _template_runs(spark: SparkSession, templates: list[tuple]) -> DataFrame:
    """One row a run of a template: its hash and words, the template's number, the place in it, and the bit and part of that place."""
    rows = [(i, q, width, found[q : q + width], q // MASK_BITS, 1 << q % MASK_BITS) for i, _, _, found, width in templates for q in range(len(found) - width + 1)]
    table = spark.createDataFrame(rows, "template int, q int, width int, run array<string>, part int, bit long")
    hashed = F.lit(None).cast("long")
    for width in sorted({t[4] for t in templates}):
        hashed = F.when(F.col("width") == width, _run_hash(F.col("run"), F.lit(0), width)).otherwise(hashed)
    return table.withColumn("hash", hashed)


def votes(docs: DataFrame, templates: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, _id, n_words, and of each diagonal on which a template got votes: template, diagonal, part, mask, first, last (words of runs).

    ``mask`` has a bit for each run of the template that is hit, MASK_BITS of them a ``part``. A document without a vote
    has one row with nulls. Rows are counted where their text is read; what is shuffled is a row a diagonal.
    """
    widths = sorted({t[4] for t in templates}) or [1]
    runs = F.broadcast(_template_runs(docs.sparkSession, templates))  # a row a word of the templates
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    n = F.size("_words")
    of_width = lambda w: F.transform(F.sequence(F.lit(0), n - w), lambda i: _run_hash(F.col("_words"), i, w))
    hashes = F.concat(*(F.when(n >= w, of_width(w)).otherwise(F.array().cast("array<bigint>")) for w in widths))
    rows = rows.select("_row", "_id", n.alias("n_words"), "_words", F.posexplode_outer(hashes).alias("_at", "_hash"))
    at, width, stop = F.col("_at"), F.lit(widths[0]), F.lit(0)
    for w, wider in zip(widths, widths[1:], strict=False):  # the runs of each width stand one after the other
        stop = stop + F.greatest(F.col("n_words") - w + 1, F.lit(0))
        at, width = F.when(F.col("_at") >= stop, F.col("_at") - stop).otherwise(at), F.when(F.col("_at") >= stop, wider).otherwise(width)
    rows = rows.withColumns({"_p": at, "_width": width})
    same = (F.col("_hash") == F.col("hash")) & (F.col("_width") == F.col("width")) & (F.slice("_words", F.col("_p") + 1, F.col("_width")) == F.col("run"))
    hit = rows.join(runs, same, "left")
    p = F.when(F.col("q").isNotNull(), F.col("_p"))
    return hit.groupBy("_row", "_id", "n_words", "template", (p - F.col("q")).alias("diagonal"), "part").agg(
        F.bit_or("bit").alias("mask"), F.min(p).alias("first"), F.max(p + F.col("_width")).alias("last"))


def spans(voted: DataFrame, templates: list[tuple], gap: int = 2, longest: float = 1.5) -> DataFrame:
    """_row, template, label, phrase, exact, begin, end (words), share, best: of each template the spans of a document that follow it.

    Diagonals up to ``gap`` apart are one span. Its share is that of the template's runs which it holds; spans of more
    than ``longest`` times the template's words are none. ``exact``: all of a template's runs on one diagonal. ``best``: no
    span that overlaps, with others between or not, has a larger share (notices of two versions differ in a word).
    """
    spark = voted.sparkSession
    facts = F.broadcast(spark.createDataFrame([(i, label, exact, len(found), len(found) - width + 1) for i, label, exact, found, width in templates],
                                              "template int, label string, phrase boolean, n_template int, n_runs int"))
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    found = voted.where("template IS NOT NULL").withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1)))
    chained = found.withColumn("chain", F.sum("fresh").over(by))
    whole = chained.groupBy("_row", "template", "chain", "part").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("begin"), F.max("last").alias("end"))
    hits = lambda df, *keys: df.groupBy("_row", "template", *keys).agg(F.sum(F.bit_count("mask")).alias("hits"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    near = hits(whole, "chain").join(facts, "template").where(F.col("end") - F.col("begin") <= longest * F.col("n_template"))
    straight = hits(found.withColumnsRenamed({"first": "begin", "last": "end"}), "diagonal").join(facts, "template").where("hits = n_runs")
    near = near.withColumn("share", F.col("hits") / F.col("n_runs"))
    places = Window.partitionBy("_row", "phrase").orderBy("begin", "end", "template")
    apart = F.coalesce((F.col("begin") >= F.max("end").over(places.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    near = near.withColumn("apart", apart).withColumn("island", F.sum("apart").over(places.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("best", F.col("share") == F.max("share").over(Window.partitionBy("_row", "phrase", "island")))
    columns = ["_row", "template", "label", "phrase"]
    return near.select(*columns, F.lit(False).alias("exact"), "begin", "end", "share", "best").unionByName(
        straight.select(*columns, F.lit(True).alias("exact"), "begin", "end", F.lit(1.0).alias("share"), F.lit(True).alias("best")))


def scan(docs: DataFrame, phrases: list[tuple[str, str]], notices: list[tuple[str, str]] = NOTICES, k: int = 3, gap: int = 2, least_share: float = 0.7,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``phrases`` and ``notices`` are (label, text). A place of a phrase is where all its words stand one after the other:
    n_base counts them, first_word and last_word are the first and the last one's first word (from 0), base_labels their
    labels. ``labels`` has those and the ones of notices of which a span holds ``least_share`` of the runs, of spans that
    overlap the best. Labels are distinct, sorted and joined by commas; none is the empty string. ``score`` is the largest share of any span, 0 without
    one. Null and empty texts have no words and no places; texts count whole; repeated rows and null ids are rows like
    any other; other columns are left out, whatever their names. A template shorter than k words has runs of its own
    length, one without words is never found.
    """
    templates = _templates(phrases, notices, k)
    voted = written(votes(docs, templates, id_col, text_col), "votes")
    base = F.col("phrase") & F.col("exact")
    said = base | (~F.col("phrase") & F.col("best") & (F.col("share") >= least_share))
    joined = lambda holds: F.array_join(F.array_sort(F.collect_set(F.when(holds, F.col("label")))), ",")
    per = spans(voted, templates, gap).groupBy("_row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("begin"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("begin"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(said).alias("labels"), F.max("share").alias("score"))
    every = voted.groupBy("_row", "_id").agg(F.max("n_words").cast("long").alias("n_words"))
    none = lambda c, value: F.coalesce(c, F.lit(value)).alias(c)
    return every.join(per, "_row", "left").select(
        F.col("_id").alias(id_col), "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
