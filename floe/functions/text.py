"""Text cleaning expressions for all-text flow tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing.  The two flow-specific tokens
# followed by the default missing-value strings of the pandas CSV reader.
FLOW_NA_TOKENS = ["?", "-"]
DEFAULT_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
NA_TOKENS = FLOW_NA_TOKENS + DEFAULT_NA_TOKENS

# The boolean text mapping (case-sensitive).
BOOL_TEXT = {"TRUE": 1, "FALSE": 0}

# A plain decimal or scientific number; the same pattern is used by the
# SQL oracle so both engines accept exactly the same literals.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

MISSING = "missing"


def c(name: str) -> Column:
    """Column by name; back-quoted so dots, slashes and spaces are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def na_to_null(col: Column, tokens=None) -> Column:
    """Missing-value tokens -> NULL (exact, case-sensitive match)."""
    tokens = NA_TOKENS if tokens is None else list(tokens)
    return F.when(col.isin(tokens), F.lit(None).cast("string")).otherwise(col)


def finite(col: Column) -> Column:
    """NaN and +-infinity -> NULL (applied after the numeric cast)."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))),
                  F.lit(None).cast("double")).otherwise(col)


def to_numeric(col: Column) -> Column:
    """P5 (+P3): text -> double, anything that is not a plain number -> NULL.

    ``try_cast`` alone would accept engine-specific literals such as ``1d``;
    the pattern pins the accepted language.  Overflow gives infinity, which
    ``finite`` turns into NULL, as do ``inf``/``nan`` texts.
    """
    t = F.trim(col)
    parsed = F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
    return finite(parsed)


def bool_text(col: Column) -> Column:
    """P4: 'TRUE' -> 1, 'FALSE' -> 0, anything else -> NULL."""
    expr = None
    for text, code in BOOL_TEXT.items():
        expr = (F.when(col == text, F.lit(code)) if expr is None
                else expr.when(col == text, F.lit(code)))
    return expr.cast("int")


def fill_missing(col: Column, value: str = MISSING) -> Column:
    """NULL category / label -> 'missing'."""
    return F.coalesce(col.cast("string"), F.lit(value))


def as_text(col: Column) -> Column:
    """Label to text."""
    return col.cast("string")
