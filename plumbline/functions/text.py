"""Text functions as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that findings must agree on.
AMOUNT_NAME_HINTS = (
    r"(amount|spend|cost|price|fee|revenue|budget|total|balance|ytd|qty|quantity)"
)
DATE_NAME_HINTS = r"(date|dt|_at|_on|timestamp|period|month|year|day)"
DATE_PATTERNS = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    r"^\d{1,2}-\d{1,2}-\d{2,4}$",
)
CURRENCY_NOISE = r"[$€£¥,\s]"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
LEGAL_SUFFIX = (
    r"\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|"
    r"lp|llp|plc|gmbh|ag|sa|sas|bv|nv|pty|pvt)\b$"
)
SIGNAL_NAME_HINTS = {
    "name": r"(name|vendor|supplier|customer|company|entity)",
    "tax_id": r"(tax.?id|ein|tin|fein|vat|abn|gst)",
    "address": r"(address|addr|street|city|state|province)",
    "zip": r"(zip|postal|post.?code)",
    "phone": r"(phone|tel|mobile|fax|contact)",
}

# White space as a Unicode-aware scripting language sees it: Java's class lacks \x1c-\x1f.
SPACE = r"[\s\x1c-\x1f]"


def name_matches(column: str, hint: str) -> bool:
    return re.search(hint, column, re.IGNORECASE) is not None


def is_blank(text: Column) -> Column:
    """Empty or white space only. ``trim`` is not enough: it strips U+0020 alone."""
    return text.rlike(rf"(?U)\A{SPACE}*\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def fold(text: Column) -> Column:
    """Normal form for fuzzy comparison: lower case, no outer white space."""
    return strip(F.lower(text))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(
        text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    # A letter whose upper case is two letters keeps only the first of them upper.
    first = lambda r: F.upper(F.left(r, F.lit(1)))
    rest = lambda t: F.lower(F.right(t, F.length(t) - 1))
    cased = F.transform(
        runs, lambda r: F.concat(F.left(first(r), F.lit(1)), rest(first(r)), rest(r))
    )
    return F.array_join(cased, "")


def canonical_form(a: Column, b: Column) -> Column:
    """The longer of two spellings (a on a tie), stripped, in title case."""
    return title_case(strip(F.when(F.length(a) >= F.length(b), a).otherwise(b)))


# --- amounts and dates -------------------------------------------------------------------


def amount_cleaned(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){CURRENCY_NOISE}", "")


def amount_is_dirty(text: Column) -> Column:
    """Carries currency noise, or is not a plain number once the noise is gone."""
    cleaned = amount_cleaned(text)
    not_number = (cleaned != "") & ~cleaned.rlike(rf"(?U){PLAIN_NUMBER}")
    return not_number | text.rlike(rf"(?U){CURRENCY_NOISE}")


def amount_value(text: Column) -> Column:
    """The number behind a noisy amount, or null."""
    return amount_cleaned(text).try_cast("double")


def matches_date_pattern(text: Column) -> Column:
    bare = strip(text)
    hit = F.lit(False)
    for pattern in DATE_PATTERNS:
        hit = hit | bare.rlike(f"(?U){pattern}")
    return hit


# --- entity signals ----------------------------------------------------------------------


def norm_generic(value: Column) -> Column:
    text = F.lower(value.cast("string"))
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    return F.coalesce(strip(F.regexp_replace(text, rf"(?U){SPACE}+", " ")), F.lit(""))


def norm_name(value: Column) -> Column:
    """Generic form without one trailing legal suffix."""
    return strip(F.regexp_replace(norm_generic(value), "(?U)" + LEGAL_SUFFIX, ""))


def norm_tax_id(value: Column) -> Column:
    bare = F.regexp_replace(value.cast("string"), rf"(?U){SPACE}|-", "")
    return F.coalesce(F.upper(bare), F.lit(""))


def digits(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), r"(?U)\D", ""), F.lit(""))


def norm_phone(value: Column) -> Column:
    return F.right(digits(value), F.lit(10))


def norm_zip(value: Column) -> Column:
    return F.left(digits(value), F.lit(5))


NORMALISERS = {
    "name": norm_name,
    "tax_id": norm_tax_id,
    "address": norm_generic,
    "zip": norm_zip,
    "phone": norm_phone,
}


def norm_signal(signal: str, columns: list[Column]) -> Column:
    """One signal over several columns: non-empty normal forms joined by a space."""
    parts = [NORMALISERS[signal](c) for c in columns]
    return strip(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
