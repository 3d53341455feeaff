"""Fill-in-the-middle by relational units.

A text is cut into units (a word with the white space before it, or white space at the end). ``posexplode`` gives a row
a unit, a window over one document's rows adds up their lengths, the two cuts that a document asks for are joined by the
unit's ordinal, and the offsets found are gathered per document; the pieces are then substrings of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.storage import free
from shelfmark.llm.wordcols import digest_number

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def units(text: Column) -> Column:
    """The units of a text, which put together are the text again; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _draws(doc_id: Column, seed: int, group: int) -> Column:
    return digest_number(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), group)


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    The id's digest decides the cuts, after which of the n units prefix and middle end (0 to n each), and the form:
    ``percent`` in a hundred texts are rearranged, ``spm_percent`` of those as suffix, prefix, middle, the rest as prefix,
    suffix, middle. A text that is empty or holds a marker stays plain. Null texts are empty and come out so; a null id
    counts as an empty one; repeated rows are rows like any other; other columns stay, and of equal names the new one
    gets an underscore. Texts are dealt by row, so that no id or source is a hot key, and one text's units are one
    group, as long as the text.
    """
    spark = docs.sparkSession
    row, first, second, text, a, b = free(docs, "_row", "_first", "_second", "_text", "_a", "_b")
    n_units, form, prefix_chars, middle_chars, output = free(docs, "n_units", "form", "prefix_chars", "middle_chars", "output")
    # every step below is keyed by the row, so texts are shuffled here and nothing is afterwards; a filter would be
    # moved before this shuffle, and the branches could not share it
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumn(row, F.monotonically_increasing_id()).repartition(n_parts, row).withColumn(text, F.coalesce(text_col, F.lit("")))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col(text).contains(marker)
    kind = (F.when((F.col(text) == "") | marked | (_draws(F.col(id_col), seed, 2) % 100 >= percent), "plain")
            .when(_draws(F.col(id_col), seed, 3) % 100 < spm_percent, "spm").otherwise("psm"))
    cut = lambda group: _draws(F.col(id_col), seed, group) % (F.col(n_units) + 1)
    asked = dealt.withColumns({n_units: F.size(units(F.col(text))).cast("long"), form: kind})
    asked = asked.withColumns({first: F.least(cut(0), cut(1)), second: F.greatest(cut(0), cut(1))})

    placed = dealt.select(row, F.posexplode_outer(F.when(kind != "plain", units(F.col(text)))).alias("_place", "_unit"))
    placed = placed.select(row, (F.col("_place") + 1).alias("_ordinal"), F.length("_unit").alias("_chars")).withColumn(
        "_end", F.sum("_chars").over(Window.partitionBy(row).orderBy("_ordinal").rowsBetween(Window.unboundedPreceding, 0)))
    requests = asked.select(row, first, second)
    found = placed.join(requests, row).where((F.col("_ordinal") == F.col(first)) | (F.col("_ordinal") == F.col(second)))
    at = lambda c: F.max(F.when(F.col("_ordinal") == F.col(c), F.col("_end")))
    offsets = found.groupBy(row).agg(at(first).alias(a), at(second).alias(b))
    x, y = (F.coalesce(c, F.lit(0)).cast("int") for c in (a, b))  # a cut before the first unit has no row
    t = F.col(text)
    prefix, middle, suffix = F.substr(t, F.lit(1), x), F.substr(t, x + 1, y - x), F.substr(t, y + 1, F.length(t))
    made = (F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
            .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(t))
    cut_up = F.col(form) != "plain"
    return asked.join(offsets, row, "left").select(
        *docs.columns, n_units, form, F.when(cut_up, x.cast("long")).alias(prefix_chars), F.when(cut_up, (y - x).cast("long")).alias(middle_chars), made.alias(output))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: what stands between the markers, put back in order."""
    def between(left: str, right: str) -> Column:
        begin, stop = F.instr(output, left) + len(left), F.instr(output, right)
        return F.substr(output, begin, stop - begin)

    end = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), end, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), end, between(SUFFIX, PREFIX))).otherwise(output))


def digest(made: DataFrame) -> DataFrame:
    """doc_id, n, form, offsets and the digests of the output and of the text rebuilt from output and form."""
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
