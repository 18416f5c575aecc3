"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a UTF-8 locale classifies it: the ASCII set plus the Unicode spaces that
# allow a line break (no-break spaces are not included).
SPACE = r"[\s\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"

# Whitespace as a browser collapses and trims it; no-break spaces count.
BROWSER_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A chain of rewrites that mentions its input two or three times per step would grow
    exponentially when Catalyst inlines it; a lambda variable keeps it linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(x: Column) -> Column:
    """Runs of whitespace become one space; the ends are kept."""
    return F.regexp_replace(x, SPACE + "+", " ")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def lenient_int(x: Column) -> Column:
    """Leading integer of a string, NULL when there is none (``16abc`` gives 16)."""
    digits = F.regexp_extract(F.trim(x), r"^(-?[0-9]+)", 1)
    return blank_to_null(digits).try_cast("int")
