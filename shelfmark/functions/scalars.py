"""Column functions that read quantities, prices, dates and codes out of label text. All run on the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, without regard to case."""
    return text.rlike("(?i)" + pattern)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text, in capitals, holds any of the words anywhere, inside other words as well."""
    return F.upper(text).rlike(P.any_of(words))


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match or where the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_unit(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    known = F.create_map(*chain.from_iterable((F.lit(w), F.lit(name)) for name, words in P.UNITS.items() for w in words))
    return F.coalesce(F.try_element_at(known, u), u)


def normalize_currency(text: Column) -> Column:
    """The first currency in the fixed order whose sign or name is in the text; INR without any."""
    out, upper = F.lit("INR"), F.upper(text)
    for name, signs in reversed(P.CURRENCIES):
        out = F.when(upper.rlike(P.any_of(signs)), name).otherwise(out)
    return out


_QUANTITY = r"(?i)(?<!\d[xX*])(?<!\d\s[xX*])\b(\d+(?:\.\d+)?)\s*(" + "|".join(P.UNIT_WORDS) + r")\b(?!\s*[xX*]\s*\d)"


def parse_quantity(text: Column) -> Column:
    """struct(value double, unit string), null where the text is a dimension or has no number with a unit."""
    value, unit = part(text, _QUANTITY, 1).try_cast("double"), part(text, _QUANTITY, 2)
    return F.when(value.isNotNull() & ~text.rlike(P.DIMENSION), F.struct(value.alias("value"), normalize_unit(unit).alias("unit")))


def parse_mrp(text: Column) -> Column:
    """struct(value double, unit string): the first number, a comma read as a point, and the currency; null outside 0.1 to 100000."""
    number = F.replace(part(F.regexp_replace(text, P.NOT_A_PRICE, ""), P.PRICE, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.between(0.1, 100000.0), F.struct(number.alias("value"), normalize_currency(text).alias("unit")))


def parse_date(text: Column) -> Column:
    """struct(value string, unit string): a numeric date, else month and year, else a number of periods, and which it was; else null.

    Each has a digit, so a text without one takes a single look; of the others each pattern is tried once until one is found.
    """
    numeric = F.regexp_replace(F.regexp_extract(text, P.DAY_MONTH_YEAR, 0), "[-.]", "/")
    pattern, month, year = P.MONTH_YEAR
    y = F.regexp_extract(text, pattern, year)
    month_year = F.concat(F.upper(F.substring(F.regexp_extract(text, pattern, month), 1, 3)), F.lit(" "), F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
    relative = F.concat(F.regexp_extract(text, P.RELATIVE, 2), F.lit(" "), F.lower(F.regexp_extract(text, P.RELATIVE, 3)))
    one = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("unit"))
    dated = (F.when(text.rlike(P.DAY_MONTH_YEAR), one(numeric, "exact_date")).when(text.rlike(pattern), one(month_year, "month_year"))
             .when(text.rlike(P.RELATIVE), one(relative, "relative_duration")))
    return F.when(text.rlike("[0-9]"), dated)


def clean_batch(text: Column) -> Column:
    """A batch code on its label's own line; null if what is left is short or names another field."""
    left = F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)" + P.LABELS["batch"], ""), "[:.]", ""))
    return F.when((F.length(left) >= 3) & ~has_any(left, P.BATCH_REJECTS), left)


def batch_value(text: Column) -> Column:
    """A batch code in a line of its own."""
    t = F.trim(text)
    return F.when((F.length(t) >= 3) & t.rlike(r"\d") & ~has_any(t, P.BATCH_VALUE_REJECTS), t)


def other_declaration(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(P.OTHER):
        out = F.when(has_any(text, words), F.concat(F.lit(name + ": "), text)).otherwise(out)
    return out


def is_non_english(text: Column) -> Column:
    """Letters of the Indic, Arabic or CJK ranges; accented Latin letters are English here."""
    return text.rlike("[ऀ-ൿ؀-ۿ一-鿿]")


def forbidden_unit(text: Column) -> Column:
    """The first forbidden unit, in the fixed order, that stands in the lower-cased text as a word; else null."""
    out, lower = F.lit(None).cast("string"), F.lower(text)
    for unit in reversed(P.FORBIDDEN_UNITS):
        out = F.when(lower.rlike(rf"\b{unit}\b"), unit).otherwise(out)
    return out


def has_tax_phrase(text: Column) -> Column:
    return F.lower(text).rlike(P.TAX_PHRASE)


def has_phone(text: Column) -> Column:
    return text.rlike(P.PHONE)


def has_email(text: Column) -> Column:
    return text.rlike(P.EMAIL)


def record_digest(*parts: Column) -> Column:
    """SHA-256 in hex of the parts with bars between; nulls are left out, as ``concat_ws`` does."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def verify_evidence(text: Column, claimed: Column) -> Column:
    """struct(computed_hash, is_tamper_free): an empty or null claim is taken as intact.

    The digest is over Latin-1 bytes, or over UTF-8 where the text has a character beyond Latin-1.
    """
    beyond = text.rlike(r"[^\x{00}-\x{FF}]")
    digest = F.sha2(F.when(beyond, F.encode(text, "UTF-8")).otherwise(F.encode(F.when(~beyond, text), "ISO-8859-1")), 256)
    return F.struct(digest.alias("computed_hash"), F.when(F.coalesce(claimed, F.lit("")) == "", True).otherwise(F.lower(claimed) == digest).alias("is_tamper_free"))


def is_json(text: Column) -> Column:
    """Whether the whole text is a JSON document; null for null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def unfenced(text: Column) -> Column:
    """What a reply has between code fences, of JSON first, of any kind else, or all of it, without white space around it."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    part = lambda c, fence, n: F.split_part(c, F.lit(fence), F.lit(n))
    return strip(F.when(text.contains("```json"), part(part(text, "```json", 2), "```", 1)).when(text.contains("```"), part(strip(text), "```", 2)).otherwise(text))


def mean_milli(hundredths: Column, n: Column) -> Column:
    """A mean of hundredths in thousandths, half to even; 0 of none."""
    return F.when(n > 0, F.bround(hundredths * 10 / n)).otherwise(0).cast("long")
