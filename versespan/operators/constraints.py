"""Row-level checks of required columns and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versespan.operators.joins import Checked


def check_constraints(df: DataFrame, not_null: list[str], key: list[str] | None = None,
                      order: list[str] | None = None) -> Checked:
    """Split rows into those a table accepts and those it rejects, with the reason.

    A row missing a required column is rejected. Of rows sharing a key the first (by
    ``order``, then by the other columns) is kept. Equal rows are counted before anything
    is compared, and rejects carry that number as ``copies``, so a key with very many
    rows is never sorted or gathered in one place.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c))
                                        for c in not_null]))
    copies = F.count("*").alias("copies")
    incomplete = df.filter(F.size(missing) > 0).groupBy(*df.columns).agg(copies).select(
        *df.columns, "copies",
        F.concat(F.lit("missing "), F.array_join(missing, ", ")).alias("reason"))
    whole = df.filter(F.size(missing) == 0)
    if not key:
        return Checked(whole, incomplete)
    complete = whole.groupBy(*df.columns).agg(copies)
    ranked = [*(order or []), *[c for c in df.columns if c not in (order or [])]]
    first = complete.groupBy(*key).agg(F.min(F.struct(*ranked)).alias("_first"))
    kept = first.select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])
    joined = complete.join(first, key)
    is_first = (F.struct(*ranked) == F.col("_first")).cast("int")
    repeated = joined.withColumn("copies", F.col("copies") - is_first).filter(
        F.col("copies") > 0).select(
        *df.columns, "copies", F.lit("duplicate key").alias("reason"))
    return Checked(kept, incomplete.unionByName(repeated))
