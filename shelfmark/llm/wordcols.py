"""Words of text columns as array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters and digits and every character beyond ASCII, in a form that Java and RE2 read alike; A-Z are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in small letters, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def words(text: Column) -> Column:
    """The words of a text in their order; none of null."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def digest_number(text: Column, group: int = 0) -> Column:
    """A group of 8 hex digits of the text's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 8 * group + 1, 8), 16, 10).cast("long")
