"""Point-in-range and range-overlap joins on chapter-sized blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.operators.joins import explode_range


def with_blocks(df: DataFrame, lo: Column, hi: Column, column: str = "block") -> DataFrame:
    """One row per block a position range touches; an empty or NULL range gives none."""
    return explode_range(df.filter(lo <= hi), A.block(lo), A.block(hi), column)


def clip_to(df: DataFrame, bounds: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Shorten ranges to what ``bounds`` (``first_pos``, ``last_pos`` per key) can reach.

    A range that runs far past the data then expands into no more blocks than the
    data has.
    """
    return df.join(bounds, keys).withColumn(lo, F.greatest(lo, "first_pos")).withColumn(
        hi, F.least(hi, "last_pos")).drop("first_pos", "last_pos")
