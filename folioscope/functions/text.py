"""Column expressions with the whitespace, missing-value and rounding rules of the data model.

Everything here is a built-in Spark expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a missing cell, besides null and blank.
NA_TOKENS = ("NA", "N/A", "None", "nan", "null")
# What a CSV reader of the pandas family takes for missing.
CSV_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: White space as Python's str.isspace sees it: the Unicode class and the four separators U+001C-U+001F.
WS = r"[\s\x1c-\x1f]"


def pystrip(c: Column) -> Column:
    """``str.strip()``: Unicode white space off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def clean_text(c: Column) -> Column:
    """:func:`collapse_ws` with null as the empty string."""
    return F.coalesce(collapse_ws(c), F.lit(""))


def clean_newlines(c: Column) -> Column:
    """Stripped, each line feed a blank, inner runs kept. Null gives the empty string."""
    return F.coalesce(F.replace(pystrip(c), F.lit("\n"), F.lit(" ")), F.lit(""))


def is_missing(c: Column) -> Column:
    """True for null, blank and the NA tokens (after trimming); never null."""
    # five letters together are in no token: a text is left at its first long word, where stripping would look through all of it
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]{5}") & c.rlike(rf"(?U)\A{WS}*(?:{'|'.join(NA_TOKENS)})?{WS}*\z")


def na_to_null(c: Column, tokens: tuple[str, ...] = CSV_NA_TOKENS) -> Column:
    """Exact NA tokens become null, as a CSV reader of the pandas family does."""
    return F.when(c.isin(*tokens), None).otherwise(c)


def np_round1(c: Column) -> Column:
    """One decimal, half to even on the scaled value."""
    return F.rint(c * 10) / 10


def is_yes(c: Column) -> Column:
    """yes or y in any case; null gives false."""
    return F.coalesce(F.lower(c).isin("yes", "y"), F.lit(False))


def icontains(c: Column, needle: str) -> Column:
    """Literal substring ignoring case; null gives false."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def imatches(c: Column, pattern: str) -> Column:
    """Regular expression ignoring case; null gives false."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def tokens(c: Column, sep: str = ",") -> Column:
    """Literal split, each piece stripped, empties kept. Null gives null."""
    return F.transform(F.split(c, r"\Q" + sep + r"\E", -1), pystrip)


def pct(n: Column, total: Column) -> Column:
    """``n / total * 100`` in that order; null where the total is 0."""
    return F.try_divide(n.cast("double"), total.cast("double")) * F.lit(100.0)
