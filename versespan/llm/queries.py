"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan.llm import (
    bpe,
    chat,
    codebooks,
    counts,
    filter_audit,
    jaccard,
    langid,
    packing,
    quality_cnn,
    quality_rules,
    secrets,
    suffix_dedup,
    topk,
)
from versespan.llm.common import held_out, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"

PREFIX_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
w AS (
  SELECT *, 24 + length(replace(replace(role, '%', '%25'), chr(10), '%0A'))
         + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number
  FROM t),
c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY number) AS stop,
         max(number) OVER (PARTITION BY conv_id) AS last
  FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR number = last THEN stop ELSE 0 END)::BIGINT
         AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op2_prefix_chat", PREFIX_CHAT_SQL)
def op2_prefix_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.prefix_examples(turns.unionByName(own)))


@query("op5_divergence_rules")
def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    features = quality_rules.materialize(
        quality_rules.rule_features(docs).drop("text"), "rules")
    judged = quality_rules.judge(features, quality_rules.language_references(features))
    return judged.select(
        "doc_id", "rule.n_words", "rule.word_chars", "rule.n_symbols", "rule.n_dup_lines",
        "rule.n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"),
                        langid.language(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


@query("op4_quality_cnn")
def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.fit(docs.filter(~held_out()),
                            read_table(spark, sf_dir, "labels").filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"),
                         quality_cnn.quality(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op1_sum_of_squares_packing")
def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


RANKS = "byte_bpe_50k.tiktoken"


@query("op7_prefix_bpe")
def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", bpe.round_trip(
        public_tokenizers.path(RANKS), public_tokenizers.PATTERN, F.col("text")).alias("found"))
    return found.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")


@query("op8_edited_counts")
def op8_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits for every document: a new beginning, a replaced stretch in the middle that
    repeats the document's source, and a deletion near the end."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = F.coalesce(F.length("text"), F.lit(0))

    def edit(start: Column, delete: int, insert: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(delete).alias("delete"),
                        insert.alias("insert"))

    edits = F.array(
        edit(F.lit(0), 0, F.lit("Edited: ")),
        edit(size / 2, 12, F.concat(F.lit(" now's from "), F.coalesce("source", F.lit("")))),
        edit(size * 9 / 10, 5, F.lit("")))
    found = docs.select("doc_id", counts.edited_counts(
        public_tokenizers.path(RANKS), public_tokenizers.PATTERN, F.col("text"), edits)
        .alias("found"))
    return found.select("doc_id", "found.n_pretokens", "found.n_tokens", "found.n_tokens_after",
                        "found.n_chars_after", "found.n_encoded")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op9_sliced_top_k", TOP_K_SQL)
def op9_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op6_secret_cnn")
def op6_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.fit(docs)
    found = docs.select("doc_id", secrets.secret_spans(model, F.col("text")).alias("found"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda s: s["kind"] != "cnn")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), x -> x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
           WHEN len(words) = 0 THEN []
           WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3),
                               i -> array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w),
c AS (                                  -- equal sets are compared once
  SELECT min(doc_id) AS id, len(sorted) AS n, sorted, list(doc_id) AS members
  FROM (SELECT doc_id, list_sort(shingles) AS sorted FROM s WHERE len(shingles) > 0)
  GROUP BY sorted),
e AS (SELECT id, n, unnest(sorted) AS shingle FROM c),
p AS (
  SELECT a.id AS a, b.id AS b, count(*) AS both, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.id < b.id
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.id, b.id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
r AS (
  SELECT id AS node, id AS reached FROM c
  UNION
  SELECT r.node, l.v FROM r JOIN l ON r.reached = l.u),
k AS (SELECT node, min(reached) AS least FROM r GROUP BY node),
m AS (SELECT unnest(members) AS doc_id, id FROM c)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(k.least, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT DISTINCT doc_id, id FROM m) m ON s.doc_id = m.doc_id
  LEFT JOIN k ON m.id = k.node
"""


@query("op3_jaccard_tiles", JACCARD_SQL)
def op3_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


FILTER_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY text) AS least
  FROM t),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
         coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM n a, n b, n c, n d, n e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS f,
         filter_order[1:step - 1] AS before
  FROM o, range(1, 6) r(step)),
p AS (
  SELECT part, filter_order, step, f, good, bad, fails, contains(fails, f) AS failing,
         len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0
           AND before <> '' AND fails <> '' AS gone
  FROM d, s),
r AS (
  SELECT part, filter_order, step, any_value(f) AS f,
         count(*) FILTER (NOT failing AND NOT gone) AS kept,
         count(*) FILTER (failing AND NOT gone) AS removed,
         count(*) FILTER (failing AND gone) AS redundant,
         count(*) FILTER (fails = f) AS unique_fails,
         count(*) FILTER (failing AND NOT gone AND good) AS good_lost,
         count(*) FILTER (failing AND NOT gone AND bad) AS toxic_lost
  FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


@query("op11_filter_audit", FILTER_AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"),
                              read_table(spark, sf_dir, "labels"))


def _codebook_sql(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """The rounds as one common table expression each: ``a`` assigns, ``c`` holds entries."""
    def assign(r: int) -> str:
        return f"""
a{r} AS (
  SELECT vec_id, part, x, entry, d FROM (
    SELECT p.vec_id, p.part, p.x, c.entry,
           list_sum(list_transform(range(1, len(p.x) + 1),
             lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT AS d
    FROM p JOIN c{r} c ON p.part = c.part)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""

    def move(r: int) -> str:
        return f"""
m{r} AS (
  SELECT part, entry, list(m ORDER BY place) AS x FROM (
    SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT part, entry, place, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (
        SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{r})
      GROUP BY part, entry, place))
  GROUP BY part, entry),
c{r + 1} AS (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x
  FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.entry = m.entry)"""

    steps = [assign(0)]
    for r in range(rounds):
        steps += [move(r), assign(r + 1)]
    return f"""
WITH v AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (
  SELECT vec_id, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS x
  FROM v, range({parts}) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v
      ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, entry, x FROM p JOIN f ON p.vec_id = f.vec_id),
{",".join(steps)},
h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM c{rounds}),
e AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT e.vec_id, code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM e JOIN v ON e.vec_id = v.vec_id, h
"""


@query("op13_adaptive_codes", _codebook_sql())
def op13_adaptive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.codes(read_table(spark, sf_dir, "embeddings"))


REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM d, range(0, greatest((length(h) // 2) - 49, 0)) r(i)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w)
      WHERE least < doc_id),
n AS (SELECT *, CASE WHEN i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new
      FROM g),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM s
      UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id),
t AS (
  SELECT p.doc_id, string_agg(CASE WHEN p.b IS NULL THEN substr(h, 2 * p.a + 1)
                                   ELSE substr(h, 2 * p.a + 1, 2 * (p.b - p.a)) END,
                              '' ORDER BY p.a) AS left_over
  FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op12_grouped_suffixes", REPEATS_SQL)
def op12_grouped_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read_table(spark, sf_dir, "documents")).drop("spans")
