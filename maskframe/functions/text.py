"""Text expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim all Unicode white space on both sides (``trim`` only knows the blank)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    t = strip(c)
    return F.when(t != "", t)


def truthy(c: Column) -> Column:
    """``1``, ``true``, ``yes`` or ``y``, trimmed and without case; null counts as false."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y"), F.lit(False))


def relative_path(c: Column) -> Column:
    """One spelling for a relative path: single slashes, no ``.`` steps, no leading or closing slash.

    ``..`` steps are kept, since resolving them needs the directory the path is relative to.
    """
    slashes = F.regexp_replace(strip(c), r"[\\/]+", "/")
    dots = F.regexp_replace(slashes, r"(?<=/|\A)(?:\./)+|/\.\z|\A\.\z", "")
    return F.regexp_replace(dots, r"\A/+|/+\z", "")


def whole_number(c: Column) -> Column:
    """Whole number as a long, however it is written (``7``, ``007``, ``7.0``, full-width digits); else null."""
    ascii_digits = F.translate(strip(c), "０１２３４５６７８９．＋－", "0123456789.+-")
    n = F.regexp_extract(ascii_digits, r"\A([+-]?[0-9]+)(?:\.0*)?\z", 1)
    return F.when(n != "", n.try_cast("bigint"))
