"""Writing corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan import schemas

# Cluster keys, fine enough that no single key value holds a large share of a table.
CLUSTERED = {
    "verses": ["language", "source_number", "book_number", "chapter", "verse"],
    "stories": ["language", "source_number", "book_number", "chapter", "verse"],
    "commentaries": ["language", "source_number", "book_number", "chapter_number_from",
                     "verse_number_from"],
    "dictionary": ["language", "source_number", "topic"],
}


def cast_table(df: DataFrame, table: str) -> DataFrame:
    """The canonical columns and types of a table; unreadable numbers are NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name)
                       for f in schemas.TABLES[table]])


def load_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the stored corpus tables; anything that is not one of the six is ignored.

    Verse-keyed tables are partitioned by language and clustered by source and book, so a
    lookup that names a source reads few row groups.
    """
    for name, df in tables.items():
        if name not in schemas.TABLES:
            continue
        rows = cast_table(df, name)
        keys = CLUSTERED.get(name)
        if keys:
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
                "overwrite").partitionBy("language").parquet(f"{path}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")


def save_bucketed(df: DataFrame, name: str, key: list[str], buckets: int,
                  path: str | None = None) -> None:
    """Store a catalog table bucketed by a join key, so joins on that key do not shuffle it.

    Verses by (source, book_number, chapter) serve address lookups whose requests are too
    many to broadcast; verses and embeddings by id serve the vector join.
    """
    writer = df.repartition(buckets, *key).write.mode("overwrite").bucketBy(
        buckets, *key).sortBy(*key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(schemas.TABLES[n]).parquet(f"{path}/{n}").select(
        *schemas.TABLES[n].names) for n in names}


def insert_if_absent(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the target lacks, one per key: what an append may add."""
    first = new.groupBy(*key).agg(F.min(F.struct(
        *[F.col(c) for c in new.columns if c not in key])).alias("_r"))
    rows = first.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c)
                          for c in new.columns])
    return rows.join(target.select(*key), key, "left_anti")


def append_absent(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> None:
    """Append to a stored table what it does not have yet."""
    target = spark.read.schema(new.schema).parquet(path)
    insert_if_absent(target, new, key).write.mode("append").parquet(path)
