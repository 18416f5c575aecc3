import re

import corpus_pipeline
import public_tokenizers
from test_jaccard import shingles
from test_tokens import rebuilt
from tokenizers import Tokenizer

from versespan.llm import quality_cnn, quality_rules, secrets


def test_stages_follow_one_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.schema == before.schema, name
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] > seen[3] == seen[4] > 100
    rows = docs.collect()
    # no two documents that stayed are near copies, no text holds what the patterns find
    sets = [shingles(r["text"]) for r in rows]
    for i, a in enumerate(sets):
        assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])
    assert not any(secrets.base_spans(r["text"]) for r in rows)
    # what is packed is what stayed
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    found, _ = rebuilt([tuple(p) for p in pieces])
    for r in rows:
        size = len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
        assert sum(x[1] for x in found[r["doc_id"]]) == size
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(
        f"{sf_dir}/labels.parquet").collect()}
    assert not [r["doc_id"] for r in rows if labels.get(r["doc_id"]) == 0] or len(
        [r for r in rows if labels.get(r["doc_id"]) == 0]) <= 2


def test_run_equals_stages_on_the_whole_table(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                              "sequence_id", "offset"]
    assert pieces.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(spark, sf_dir):
    """Labelled clean documents of 50 words and more pass the two filters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    clean = {r["doc_id"] for r in docs.join(labels, "doc_id").collect()
             if len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 50}
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    kept = corpus_pipeline.rules(spark, kept, sf_dir)
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(clean & left) >= 0.97 * len(clean)
    assert quality_cnn.SAMPLE_TEXTS and quality_rules.MIN_WORDS


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns that are called like the stages' own ones, nulls, repeated and no rows."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _copy string, "
              "_clean string, _CLEAN_ int")
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", "s", 5, "a", "b", 1), (2, words + " more", "en", "s", 5, "c", "d", 2),
            (3, None, None, None, None, None, None, None), (None, words, "en", "s", 5, "e", "f", 3),
            (4, 'password: "hunter2hunter2"', "en", "s", 9, "g", "h", 4),
            (4, 'password: "hunter2hunter2"', "en", "s", 9, "g", "h", 4)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [r for r in rows if r[0] != 2], key=repr)
    clean = corpus_pipeline.without_secrets(spark, docs, "")
    assert clean.schema == docs.schema
    found = clean.collect()
    assert [tuple(r)[5:] for r in found] == [r[5:] for r in rows]
    assert [r["text"] for r in found[:4]] == [r[1] for r in rows[:4]]
    assert all("hunter2" not in r["text"] and r["n_chars"] == len(r["text"]) for r in found[4:])
    none = spark.createDataFrame([], schema)
    assert corpus_pipeline.near_duplicates(spark, none, "").collect() == []
    assert corpus_pipeline.without_secrets(spark, none, "").collect() == []
