"""Expressions over cells, names and numbers of delimited files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statsift.functions.folding import fold

# Markers that stand for a missing cell, when validating and when reading headers.
MISSING_CELLS = ("", ".", "-", "na", "nan", "n/a", "#na", "null", "none", "nd", "<na>", "?")
MISSING_IN_HEADERS = ("na", "nan", "n/a", "#na", ".", "-", "null", "none", "")
# Fixed value: a plain number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Fixed value: what counts as a number in a header.
NUMBER_IN_HEADERS = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+)?|\.\d+(_\d+)*(e[+-]?\d+)?|nan|inf|infinity)$"
# Fixed value: characters that fold to one underscore in a column name.
FOLDED = r"""[\s\x1c-\x1f\x{85}\x{1680}\x{2028}\x{2029}\-\.:;,/\\|()\[\]{}'"`+*#@!?%^&=<>~$]+"""
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def trimmed(value: Column) -> Column:
    """Without white space at either end (``trim`` alone strips spaces only)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def is_missing(value: Column) -> Column:
    """A missing marker, for validation."""
    return F.lower(trimmed(value)).isin(*MISSING_CELLS)


def looks_like_missing(value: Column) -> Column:
    """A missing marker, for header work."""
    return F.lower(trimmed(value)).isin(*MISSING_IN_HEADERS)


def is_numeric_cell(value: Column) -> Column:
    """A number written plainly and not a missing marker, none of which has a digit."""
    return trimmed(value).rlike(NUMBER)


def reads_as_number(value: Column) -> Column:
    """What counts as a number in a header: also ``nan`` and ``inf``."""
    return F.coalesce(trimmed(value).rlike(NUMBER_IN_HEADERS), F.lit(False))


def finite(value: Column) -> Column:
    """The cell as a finite double, else NULL."""
    number = F.when(trimmed(value).rlike(NUMBER), trimmed(value).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)  # the pattern lets no NaN through, but 1e999


def is_data_row(cells: Column, least: float = 0.4, bare: Callable[[Column], Column] = trimmed) -> Column:
    """At least ``least`` of the cells that are not blank are numeric.

    ``bare``: a cell without white space at its ends, where that takes less than to trim it."""
    filled = F.filter(cells, lambda v: bare(v) != "")
    numeric = F.filter(filled, lambda v: bare(v).rlike(NUMBER))
    return F.coalesce(F.try_divide(F.size(numeric), F.size(filled)) >= least, F.lit(False))


def normalised_name(name: Column) -> Column:
    """A column name in its form for comparison.

    Compatibility forms, marks and case are folded as ``folding.fold`` says; punctuation and
    white space fold to single underscores."""
    plain = fold(F.regexp_replace(F.coalesce(name, F.lit("")), "\ufeff", ""))
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, FOLDED, "_"), "_+", "_"), "^_|_$", "")
    return F.when(name.rlike(r"\A[A-Za-z0-9]+(?:[._:\-][A-Za-z0-9]+)*\z"), F.translate(F.lower(name), ".:-", "___")).otherwise(folded)  # most cells, and quicker


def parse_count(text: Column) -> Column:
    """A whole number that may carry thousands separators; NULL if there is none, or a decimal."""
    number = F.regexp_extract(text, "(\\d{1,3}(?:[,   ]\\d{3})+|\\d+)", 1)
    digits = F.regexp_replace(number, "[,   ]", "")
    return F.when(~text.rlike(r"\d[.eE]\d|\d[eE][+-]\d"), F.when(digits != "", digits.try_cast("bigint")))


def as_flag(value: Column) -> Column:
    """TRUE, FALSE or NULL from a word."""
    word = F.lower(trimmed(value.cast("string")))
    return F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False)


def as_int(value: Column) -> Column:
    """A whole number, else NULL."""
    return trimmed(value.cast("string")).try_cast("bigint")


def blank_to_null(value: Column) -> Column:
    """NULL for a blank cell or one of the catalogue's missing markers."""
    word = trimmed(value)
    return F.when(~F.lower(word).isin("", "na", "nr", "n/a", "none", "null"), word)


def year_of(date: Column) -> Column:
    """The first four digits that look like a year."""
    return F.nullif(F.regexp_extract(date, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).try_cast("int")


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts, whatever the case; NULL text: FALSE."""
    wanted = [p.strip().lower() for p in parts if p.strip()]
    found = F.lit(False)
    for part in wanted:
        found = found | F.contains(F.lower(text), F.lit(part))
    return F.coalesce(found, F.lit(False))


def safe_divide(a: Column, b: Column, places: int = 4) -> Column:
    """a / b rounded; NULL where b is 0 or unknown."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def transfer_reduction(received: Column, size: Column) -> Column:
    """The share of a file that was not read; NULL where the size is unknown or 0."""
    return F.when(size > 0, F.greatest(F.lit(0.0), F.lit(1.0) - received / size))
