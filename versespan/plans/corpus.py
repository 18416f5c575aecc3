"""The corpus tables, derived from the driver tables, in Spark and in SQL.

``documents`` gives the corpus: 20 parallel sources, one book per document, a line is a
chapter and a piece of a line (cut at ``'. '``) a verse. Every derivation covers the whole
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan.functions import address as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cores when the files give fewer partitions than there are.

    A single small file is one task otherwise; a large table is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return spread(docs, "doc_id").withColumn("book_number", (
        F.floor(F.col("doc_id") / 20)).cast("int")).withColumn(
        "source_number", (F.col("doc_id") % 20).cast("int"))


def lineitem(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem").select(*columns))


def raw_verses(docs: DataFrame) -> DataFrame:
    lines = docs.select("*", F.posexplode(F.split("text", "\n")).alias("_c", "_line"))
    pieces = lines.select(*docs.columns, "_c", F.posexplode(
        F.split("_line", r"\. ")).alias("_v", "_piece"))
    return pieces.filter(F.trim("_piece") != "").select(
        *[c for c in docs.columns if c != "text"], (F.col("_c") + 1).alias("chapter"),
        (F.col("_v") + 1).alias("verse"), F.col("_piece").alias("text"))


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.concat(F.lit("B"), F.col("book_number").cast("string"))
    raw = raw_verses(documents(spark, sf_dir)).withColumnRenamed("lang", "language")
    return raw.select(
        A.verse_id(F.col("language"), F.col("source_number"), F.col("book_number"),
                   F.col("chapter"), F.col("verse")).alias("id"),
        "language", "source", book.alias("book"),
        F.concat(F.lit("Book "), F.col("book_number").cast("string")).alias("book_name"),
        A.address(book, F.col("chapter"), F.col("verse")).alias("address"),
        "source_number", "book_number", "chapter", "verse", "text", "doc_id")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter directory, read off the lines: each is one chapter of one book."""
    lines = documents(spark, sf_dir).select("source", "book_number", F.posexplode(
        F.split("text", "\n")).alias("_c", "_line"))
    pieces = F.exists(F.split("_line", r"\. "), lambda p: F.trim(p) != "")
    return lines.filter(F.col("_line").rlike("[^ .]") | pieces).select(
        "source", "book_number", (F.col("_c") + 1).alias("chapter"))


def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one verse, found without expanding them.

    Any character that separates nothing settles it; only texts of nothing but spaces,
    line ends and full stops are looked at piece by piece.
    """
    pieces = F.exists(F.split("text", r"\n|\. "), lambda p: F.trim(p) != "")
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[^ \n.]") | pieces)
    return docs.select(
        F.col("lang").alias("language"), "source",
        F.floor(F.col("doc_id") / 20).cast("int").alias("book_number"),
        (F.col("doc_id") % 20).cast("int").alias("source_number"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_documents(spark, sf_dir).select(
        "language", "source_number", "book_number",
        F.concat(F.lit("B"), F.col("book_number").cast("string")).alias("short_name")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_documents(spark, sf_dir).select(
        "language", "source_number", F.col("source").alias("name")).distinct()


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses(spark, sf_dir).filter(F.length("text") % 7 == 0).select(
        "language", "source_number", "book_number", "chapter", "verse",
        F.split_part("text", F.lit(" "), F.lit(1)).alias("title"))


def commentaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("text")
    return verses(spark, sf_dir).filter(length % 11 == 0).select(
        "language", "source_number", "book_number",
        F.col("chapter").alias("chapter_number_from"), F.col("verse").alias("verse_number_from"),
        (F.col("chapter") + length % 3).alias("chapter_number_to"),
        (F.col("verse") + 5).alias("verse_number_to"),
        F.substring("text", 1, 3).alias("marker"), "text")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    full = flag != "N"
    rows = lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").select(
        (F.col("l_suppkey") % 50).alias("book_number"), F.col("l_linenumber").alias("chapter"),
        F.col("l_quantity").alias("verse"), (part % 50).alias("b1"),
        (1 + F.col("l_linenumber") % 5).alias("c1"), (1 + F.col("l_orderkey") % 20).alias("v1"),
        F.when(flag == "R", part % 50).when(flag == "A", (part + 1) % 50).alias("b2"),
        F.when(full, 1 + F.col("l_linenumber") % 5).alias("c2"),
        F.when(full, 4 + F.col("l_orderkey") % 20).alias("v2"),
        F.when(F.col("l_discount") > 0, F.floor(F.col("l_extendedprice") / 100)).alias("rate"))
    return rows.select(*[F.col(c).cast("int").alias(c) for c in rows.columns])


GREEK = ("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω")


def greek(text):
    """Latin letters written with the Greek letters that beta code maps back to them."""
    return F.translate(F.lower(text), *GREEK)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each word of ``benchmark``; words of seven letters get a broken one."""
    plain = F.regexp_replace(F.lower("text"), f"[^{GREEK[0]}]+", " ")
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(plain, " ")).alias("topic")).filter("topic <> ''").distinct()
    w = F.col("topic")
    entry = F.concat(
        F.lit("<dl><dt><a>L"), w, F.lit('</a></dt><dd><span class="meaning">of <i>'), w,
        F.lit('</i></span><span class="parse"> P'), w,
        F.lit('</span><ul><li><a href="S:1">F'), w, F.lit('</a></li><li><a href="T:1">x</a>'
              '</li><li><a href="S:2">G'), w, F.lit("</a></li></ul></dd></dl>"))
    return words.select(
        F.lit("grc").alias("language"), F.lit(1).alias("source_number"), "topic",
        F.when(F.length("topic") == 7, F.lit("<dl><dt>")).otherwise(entry).alias("definition"))


def verse_embeddings(spark: SparkSession, sf_dir: str, corpus: DataFrame,
                     *columns: str) -> DataFrame:
    """A stored vector for every verse, spread over the rows of ``embeddings``; of the verse its
    id and ``columns``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    total = F.lit(vectors.count())
    spot = F.pmod(F.col("doc_id") * 31 + F.col("chapter") * 7 + F.col("verse"), total)
    return corpus.select("id", *columns, spot.alias("vec_id")).join(vectors, "vec_id").select(
        "id", *columns, "embedding")


# The same tables as common table expressions.
VERSES = """
l as (select lang, source, doc_id,
        generate_subscripts(string_split(text, chr(10)), 1) chapter,
        unnest(string_split(text, chr(10))) line from documents),
p as (select lang, source, doc_id, chapter,
        generate_subscripts(string_split(line, '. '), 1) verse,
        unnest(string_split(line, '. ')) text from l),
verses as (select concat(lang,'/',doc_id%20,'/',doc_id//20,'/',chapter,'/',verse) id,
        lang as language, source, concat('B',doc_id//20) book,
        concat('Book ',doc_id//20) book_name,
        cast(doc_id%20 as int) source_number, cast(doc_id//20 as int) book_number,
        cast(chapter as int) chapter, cast(verse as int) verse,
        concat('B',doc_id//20,' ',chapter,',',verse) address, text, doc_id
      from p where trim(text) <> '')"""
BOOKS = VERSES + """,
books as (select distinct language, source_number, book_number, book short_name from verses)"""
STORIES = VERSES + """,
stories as (select language, source, source_number, book, book_number, chapter, verse,
        split_part(text,' ',1) title from verses where length(text) % 7 = 0),
bounds as (select *, lead(chapter) over w nc, lead(verse) over w nv from stories
      window w as (partition by language, source_number, book_number
                   order by chapter, verse, title)),
kept as (select *, case when nc > chapter and nv = 1 then nc - 1 else nc end lc
      from bounds where not (nc = chapter and nv = verse + 1)),
spanned as (select *, unnest(range(chapter, lc + 1)) ch from kept),
ranged as (select *, case when ch = chapter then verse else 1 end fv,
        case when nc = chapter then nv - 1
             when ch = lc and nv <> 1 then nv - 1 end tv from spanned),
rendered as (select language, source, book, book_number, title,
        case when tv is null then concat(book,' ',ch,',',fv,'-')
             when tv = fv then concat(book,' ',ch,',',fv)
             when tv = 0 then concat(book,' ',ch,',1')
             else concat(book,' ',ch,',',fv,'-',tv) end address,
        1000 * ch + fv a,
        1000 * ch + case when tv is null then 999 when tv = 0 then 1 else tv end b
      from ranged)"""
REFS = """
refs as (select cast(l_suppkey%50 as int) book_number, l_linenumber chapter,
        cast(l_quantity as int) verse, cast(l_partkey%50 as int) b1,
        1+l_linenumber%5 c1, cast(1+l_orderkey%20 as int) v1,
        cast(case l_returnflag when 'R' then l_partkey%50
                               when 'A' then (l_partkey+1)%50 end as int) b2,
        case when l_returnflag<>'N' then 1+l_linenumber%5 end c2,
        cast(case when l_returnflag<>'N' then 4+l_orderkey%20 end as int) v2,
        cast(case when l_discount>0 then floor(l_extendedprice/100) end as int) rate
      from lineitem)"""


def reference_label(n1: str, n2: str) -> str:
    return f"""trim(case
        when b2 is not null and c2 is not null and v2 is not null and b1 = b2 and c1 = c2
          then coalesce({n1},'') || ' ' || c1 || ',' || v1 || '-' || v2
        when b2 is not null and c2 is not null and v2 is not null
          then coalesce({n1},'') || ' ' || c1 || ',' || v1 || '-' ||
               coalesce({n2},'') || ' ' || c2 || ',' || v2
        else coalesce({n1},'') || ' ' || c1 || ',' || v1 end)"""
