"""From raw documents to packed sequences: the training-data operators one after another.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given, and returns the
columns of ``docs`` (the last one: the pieces of the packed sequences).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan.llm import jaccard, packing, quality_cnn, quality_rules, secrets
from versespan.llm.common import held_out, read_table, spare_name
from versespan.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs.filter(~held_out()), labels))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or their divergence from all languages rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return jaccard.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; ``n_chars`` follows where a text changed. A NULL text
    stays NULL; other columns, whatever their names, stay as they are."""
    model, name = secrets.fit(docs), spare_name(docs, "_clean")
    clean = docs.withColumn(name, secrets.redacted(model, F.col("text")))
    changed = F.col(name) != F.col("text")
    return clean.select(*[
        F.col(name).alias(c) if c == "text" else
        F.when(changed, F.length(name)).otherwise(F.col(c)).cast(
            docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Trained networks decide what stays, which SQL can not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written out before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
