"""Merging source files, key checks, inserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from versespan.operators.constraints import check_constraints
from versespan.plans import corpus as K
from versespan.plans.registry import query
from versespan.sources import files as I
from versespan.sources.sinks import cast_table, insert_if_absent


@query("corpus_union", f"""with {K.VERSES}
select id, language, source, book, book_name, address, source_number, book_number, chapter,
  verse, text from verses""")
def corpus_union(spark, d):
    corpus = K.verses(spark, d)
    halves = [{"verses": corpus.filter(F.col("language") == "en")},
              {"verses": corpus.filter(F.col("language") != "en")}]
    return cast_table(I.union_languages(halves)["verses"], "verses")


def _files(spark, d):
    docs = K.documents(spark, d).withColumnRenamed("lang", "language")
    more = F.when(F.col("doc_id") % 40 < 20, ".parquet").otherwise(".more.parquet")
    path = F.concat(F.col("language"), F.lit("/x/"), F.col("source"), more)
    return docs.withColumn("path", path).withColumn("source_name", I.file_name(F.col("path")))


_FILES = """f as (select doc_id, lang as language, source as name, lang || '/x/' || source ||
    case when doc_id % 40 < 20 then '.parquet' else '.more.parquet' end path from documents),
numbered as (select language, name, first_path, row_number() over (
    partition by language order by first_path) source_number
  from (select language, name, min(path) first_path from f group by 1, 2))"""


@query("assign_source_numbers", f"""with {_FILES}
select language, name, first_path, cast(source_number as int) source_number from numbered""")
def assign_source_numbers(spark, d):
    return I.assign_source_numbers(_files(spark, d).select(
        "language", F.col("source_name").alias("name"), "path"))


_INFO = """info as (
  select doc_id, 'description' as name, 'quality ' || quality as value from labels
  union all select doc_id, 'origin', source from documents
  union all select doc_id, 'chapter_string', lang from documents
  union all select doc_id, 'unknown', lang from documents)"""


def _info(spark, d):
    labels, docs = K.table(spark, d, "labels"), K.table(spark, d, "documents")
    return labels.select("doc_id", F.lit("description").alias("name"), F.concat(
        F.lit("quality "), F.col("quality").cast("string")).alias("value")).unionByName(
        docs.select("doc_id", F.inline(F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (
                ("origin", "source"), ("chapter_string", "lang"), ("unknown", "lang"))]))))


@query("info_pivot", f"""with {_INFO}
select doc_id, max(value) filter (name = 'description') description,
  max(value) filter (name = 'detailed_info') detailed_info,
  max(value) filter (name = 'origin') origin,
  max(value) filter (name = 'chapter_string') chapter_string,
  max(value) filter (name = 'chapter_string_ps') chapter_string_ps
from info group by 1""")
def info_pivot(spark, d):
    return I.pivot_info(_info(spark, d), ["doc_id"])


@query("split_by_language", """select doc_id as path, replace(source, 's', '_') as name, lang as language,
  case when doc_id in (select doc_id from labels) then null else 'no language' end reason
from documents""")
def split_by_language(spark, d):
    docs = K.table(spark, d, "documents")
    info = docs.join(K.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("path"), F.lit("language").alias("name"),
        F.col("lang").alias("value"))
    files = docs.select(F.col("doc_id").alias("path"),
                        F.translate("source", "s", "'").alias("name"))
    kept, rejected = I.split_by_language(info, files)
    named = rejected.join(docs.select(
        F.col("doc_id").alias("path"), F.translate("source", "s", "_").alias("name"),
        F.col("lang").alias("language")), "path")
    return kept.withColumn("reason", F.lit(None).cast("string")).select(
        "path", "name", "language", "reason").unionByName(
        named.select("path", "name", "language", "reason"))


@query("unique_sources", """select language, name, arg_min(doc_id, doc_id) doc_id,
  arg_min(n_chars, doc_id) n_chars
from (select lang as language, source as name, doc_id, n_chars from documents) group by 1, 2""")
def unique_sources(spark, d):
    rows = K.table(spark, d, "documents").select(
        F.col("lang").alias("language"), F.col("source").alias("name"), "doc_id", "n_chars")
    return I.first_per_key(rows, ["language", "name"], ["doc_id"])


@query("schema_drift_union", """
select 'd' || doc_id id, lang as language, source as title, text, cast(n_chars as int) n_chars
from documents
union all select 'c' || conv_id || '/' || turn, null, role, text, null from conversations""")
def schema_drift_union(spark, d):
    wanted = {"id": "string", "language": "string", "title": "string", "text": "string",
              "n_chars": "int"}
    docs = K.table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("language"), F.col("source").alias("title"), "text", "n_chars")
    talk = K.table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("id"), "role", "text")
    return I.union_aligned([I.align_schema(df, wanted, {"title": ["role"]})
                            for df in (docs, talk)])


_MERGED = f"""{_FILES},
parts as (select lang, doc_id,
        generate_subscripts(string_split(text, chr(10)), 1) chapter,
        unnest(string_split(text, chr(10))) line from documents),
raw as (select doc_id, chapter, generate_subscripts(string_split(line, '. '), 1) verse,
        unnest(string_split(line, '. ')) text from parts),
books as (select distinct path, doc_id // 20 book_number, 'B' || doc_id // 20 short_name,
        case when path not like '%.more.%' then 'Book ' || doc_id // 20 end long_name from f)"""


@query("merge_corpus", f"""with {_MERGED}
select concat(language, '/', source_number, '/', b.book_number, '/', chapter, '/', verse) id,
  language, name as source, short_name book, coalesce(long_name, short_name) book_name,
  concat(short_name, ' ', chapter, ',', verse) address,
  cast(source_number as int) source_number, cast(b.book_number as int) book_number,
  cast(chapter as int) chapter, cast(verse as int) verse, text
from raw join f using (doc_id) join numbered using (language, name)
join books b on b.path = f.path and b.book_number = doc_id // 20
where trim(text) <> ''""")
def merge_corpus(spark, d):
    return _merged(spark, d)["verses"]


def _merged(spark, d):
    files = _files(spark, d)
    keys = ["path", "language", "source_name"]
    plain = ~F.col("path").contains(".more.")
    short = F.concat(F.lit("B"), F.col("book_number").cast("string"))
    long = F.when(plain, F.concat(F.lit("Book "), F.col("book_number").cast("string")))
    info = files.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
            ("description", F.col("source")), ("origin", F.col("path")),
            ("language", F.col("language")))]))).distinct()
    raw = K.raw_verses(files)
    return I.merge_corpus({
        "info": info,
        "books": files.select(*keys, "book_number", short.alias("short_name"),
                              long.alias("long_name")).distinct(),
        "verses": raw.select(*keys, "book_number", "chapter", "verse", "text"),
        "stories": raw.filter(F.length("text") % 7 == 0).select(
            *keys, F.when(F.col("verse") % 3 == 1, F.col("book_number").cast("string"))
            .when(F.col("verse") % 3 == 2, F.concat(
                F.col("book_number").cast("string"), F.lit("z"))).alias("book_number"),
            "chapter", "verse", "text"),
    })


@query("merge_sources", f"""with {_FILES}
select concat(language, '/', source_number) id, language, cast(source_number as int) source_number,
  name, name as description_short, first_path origin from numbered""")
def merge_sources(spark, d):
    return _merged(spark, d)["sources"].select(
        "id", "language", "source_number", "name", "description_short", "origin")


@query("merge_stories", f"""with {_MERGED}
select language, cast(source_number as int) source_number,
  case when verse % 3 <> 0 then cast(doc_id // 20 as int) end book_number,
  cast(chapter as int) chapter, cast(verse as int) verse, text as title
from raw join f using (doc_id) join numbered using (language, name)
where trim(text) <> '' and length(text) % 7 = 0 and (verse % 3 = 0 or doc_id // 20 >= 10)""")
def merge_stories(spark, d):
    return _merged(spark, d)["stories"]


@query("constraint_rejects", """with r as (
  select l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'R') flag from lineitem),
c as (select *, count(*) copies from r group by all),
k as (select *, row_number() over (partition by l_orderkey, l_linenumber
        order by l_partkey, flag) n from c where flag is not null)
select l_orderkey, l_linenumber, l_partkey, flag, copies, 'missing flag' reason
from c where flag is null
union all select l_orderkey, l_linenumber, l_partkey, flag,
  copies - case when n = 1 then 1 else 0 end, 'duplicate key'
from k where copies - case when n = 1 then 1 else 0 end > 0""")
def constraint_rejects(spark, d):
    return _checked(spark, d).rejects


@query("constraint_kept", """select l_orderkey, l_linenumber, l_partkey, flag from (
  select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, flag) n
  from (select l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'R') flag
        from lineitem) where flag is not null) where n = 1""")
def constraint_kept(spark, d):
    return _checked(spark, d).rows


def _checked(spark, d):
    rows = K.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("flag"))
    return check_constraints(rows, ["l_orderkey", "l_linenumber", "flag"],
                             ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("insert_if_absent", """select user_id, arg_min(event_id, event_id) event_id
from events where user_id not in (select doc_id from labels) group by 1""")
def insert_rows_if_absent(spark, d):
    new = K.table(spark, d, "events").select("user_id", "event_id")
    target = K.table(spark, d, "labels").select(F.col("doc_id").alias("user_id"))
    return insert_if_absent(target, new, ["user_id"])
