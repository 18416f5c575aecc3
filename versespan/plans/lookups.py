"""Addresses, verses, commentaries, stories, dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.functions import text as X
from versespan.functions.core import squeeze
from versespan.functions.greek import greek_to_betacode
from versespan.operators import commentaries as C
from versespan.operators import dictionary as D
from versespan.operators import lookup as L
from versespan.operators import stories as S
from versespan.operators.intervals import store_index
from versespan.operators.references import first_book_names
from versespan.plans import corpus as K
from versespan.plans.registry import query
from versespan.session import shared_dir

_VERSE_COLUMNS = ["request_id", "id", "language", "source", "book", "address",
                  "source_number", "book_number", "chapter", "verse", "text"]


def document_requests(spark, d):
    """One address per document, in five spellings, in the document's own source."""
    book = F.concat(F.lit("B"), F.floor(F.col("doc_id") / 20).cast("string"))
    form = F.col("doc_id") % 5
    address = (
        F.when(form == 0, F.concat(book, F.lit(" 1,1-3")))
        .when(form == 1, F.concat(book, F.lit(" 1:2")))
        .when(form == 2, F.concat(book, F.lit(" 2")))
        .when(form == 3, book)
        .otherwise(F.concat(book, F.lit(" 1,1.2-3.2-"))))
    return K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), address.alias("address"), "source")


_WANTED = """case d.doc_id % 5
    when 0 then v.chapter = 1 and v.verse between 1 and 3
    when 1 then v.chapter = 1 and v.verse = 2
    when 2 then v.chapter = 2
    when 3 then true
    else v.chapter = 1 and v.verse <= 999 end"""

FETCH_VERSES = f"""with {K.VERSES}
select d.doc_id request_id, v.id, v.language, v.source, v.book, v.address, v.source_number,
       v.book_number, v.chapter, v.verse, v.text
from documents d join verses v
  on v.source = d.source and v.book_number = d.doc_id // 20 and {_WANTED}"""


@query("fetch_verses", FETCH_VERSES)
def fetch_verses(spark, d):
    found = L.fetch_verses(document_requests(spark, d), K.verses(spark, d), K.books(spark, d),
                           K.chapters(spark, d))
    return found.rows.select(*_VERSE_COLUMNS)


@query("fetch_verses_no_source", f"""with {K.VERSES}
select b.item_id request_id, v.id, v.source, v.chapter, v.verse, v.text
from benchmark b join verses v on v.book_number = b.item_id
 and case b.item_id % 3 when 0 then v.chapter = 1 and v.verse <= 2
                        when 1 then v.chapter = 2 else true end""")
def fetch_verses_no_source(spark, d):
    item = F.col("item_id")
    book = F.concat(F.lit("B"), item.cast("string"))
    requests = K.table(spark, d, "benchmark").select(
        item.alias("request_id"),
        F.when(item % 3 == 0, F.concat(book, F.lit(" 1,1-2")))
        .when(item % 3 == 1, F.concat(book, F.lit(" 2"))).otherwise(book).alias("address"),
        F.lit(None).cast("string").alias("source"))
    found = L.fetch_verses(requests, K.verses(spark, d), K.books(spark, d),
                           K.chapters(spark, d))
    return found.rows.select("request_id", "id", "source", "chapter", "verse", "text")


@query("parse_addresses", """with q as (
  select l_orderkey request_id, 'P' || l_partkey book, l_linenumber n, l_suppkey % 9 + 1 a,
         l_partkey % 12 + 1 b, cast(l_quantity as int) c from lineitem)
select request_id, book, n chapter, c verse from q where n in (1, 4, 7)
union all select request_id, book, n, cast(unnest(range(a, b + 1)) as int) from q where n in (1, 4, 7) and a <= b
union all select request_id, book, n, c + 1 from q where n in (1, 4, 7) and a <= b
union all select request_id, book || ' x', n, null from q where n in (2, 5)
union all select request_id, book, n, cast(unnest(range(990 + a, 1000)) as int) from q where n = 3
union all select request_id, book, null, null from q where n = 6""")
def parse_addresses(spark, d):
    n = F.col("l_linenumber")
    book = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    a = (F.col("l_suppkey") % 9 + 1).cast("string")
    b = (F.col("l_partkey") % 12 + 1).cast("string")
    c = F.col("l_quantity").cast("int")
    address = (
        F.when(n.isin(1, 4, 7), F.concat(
            book, F.lit(" "), n.cast("string"), F.lit(","), c.cast("string"), F.lit("."), a,
            F.lit("-"), b, F.lit("."), (c + 1).cast("string")))
        .when(n.isin(2, 5), F.concat(F.lit("  "), book, F.lit("  x "), n.cast("string")))
        .when(n == 3, F.concat(book, F.lit(" 3:"),
                               (F.col("l_suppkey") % 9 + 991).cast("string"), F.lit("-")))
        .when(n == 6, book))
    requests = K.lineitem(spark, d, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").select(
        F.col("l_orderkey").alias("request_id"), address.alias("address"))
    return L.parse_addresses(requests).rows


@query("address_rejects", """select l_orderkey request_id,
  case when l_linenumber % 3 = 1 then 'verse is not a number'
       else 'chapter is not a number' end reason
from lineitem where l_linenumber % 3 <> 0""")
def address_rejects(spark, d):
    n = F.col("l_linenumber")
    address = (
        F.when(n % 3 == 0, F.concat(F.lit("P 1,"), n.cast("string"), F.lit(".9-5..2")))
        .when(n % 3 == 1, F.concat(F.lit("P 1,"), n.cast("string"), F.lit("..2")))
        .otherwise(F.concat(F.lit("P 9999999999,"), n.cast("string"))))
    requests = K.lineitem(spark, d, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").select(
        F.col("l_orderkey").alias("request_id"), address.alias("address"))
    return L.parse_addresses(requests).rejects


@query("first_book_name", f"""with {K.BOOKS}
select language, book_number, arg_min(short_name, source_number) short_name
from books group by all""")
def first_book_name(spark, d):
    return first_book_names(K.books(spark, d), "language", "book_number")


@query("verse_records", f"""with {K.VERSES}
select book_number, chapter, verse,
  case when length(text) % 2 = 0 then source || ':' || address else id end verse_id,
  language, source, address, text from verses""")
def verse_records(spark, d):
    rows = K.verses(spark, d).withColumn(
        "id", F.when(F.length("text") % 2 == 1, F.col("id")))
    return L.decode_verses(rows)


@query("psalm_groups", f"""with {K.VERSES}
select doc_id request_id, bool_or(book_number = 23) is_psalms from verses group by 1""")
def psalm_groups(spark, d):
    return L.flag_psalms(K.verses(spark, d).withColumnRenamed("doc_id", "request_id"), 23)



def verse_requests(spark, d):
    return K.verses(spark, d).select(F.col("id").alias("request_id"),
                                     F.col("id").alias("verse_id"))


@query("split_verse_ids", f"""with {K.VERSES}
select id request_id, language, source_number, book_number, chapter, verse from verses
where length(text) % 3 <> 0""")
def split_verse_ids(spark, d):
    requests = K.verses(spark, d).select(
        F.col("id").alias("request_id"),
        F.when(F.length("text") % 3 == 0, F.replace("id", F.lit("/"), F.lit("//")))
        .otherwise(F.col("id")).alias("verse_id"))
    return L.split_ids(requests).rows.drop("verse_id")


@query("commentary_lookup", f"""with {K.VERSES},
commentaries as (select language, source_number, book_number, chapter cf, verse vf,
    chapter + length(text) % 3 ct, verse + 5 vt, substr(text,1,3) marker, text
  from verses where length(text) % 11 = 0)
select v.id request_id, c.marker, c.text, c.cf chapter_from, c.vf verse_from
from verses v join commentaries c using (language, source_number, book_number)
where 1000 * v.chapter + v.verse between 1000 * c.cf + c.vf and 1000 * c.ct + c.vt""")
def commentary_lookup(spark, d):
    return C.fetch_commentaries(verse_requests(spark, d), K.commentaries(spark, d)).rows


@query("commentary_links", f"""with {K.VERSES}
select id, source, n.pos, case n.pos when 0 then address else book end address
from verses, (values (0), (1)) n(pos)""")
def commentary_links(spark, d):
    text = F.concat(F.lit('see <a href="B:1" class="x B">'), F.col("address"),
                    F.lit('</a> and <a class="C">no</a> <a class="B">'), F.col("book"),
                    F.lit("</a>."))
    rows = K.verses(spark, d).select("id", "source", text.alias("text"))
    return C.commentary_links(rows)


@query("annotate_links", f"""with {K.VERSES}
select id, 'see <a class="B" data-source="' || source || '" data-address="' || address ||
  '">' || address || '</a> ' || text as text from verses""")
def annotate_links(spark, d):
    html = F.concat(F.lit('see <a class="B">'), F.col("address"), F.lit("</a> "), F.col("text"))
    return K.verses(spark, d).select("id", X.annotate_links(html, F.col("source")).alias("text"))


@query("render_stories", f"""with {K.STORIES}
select source, book, title, address, cast(a as bigint) a, cast(b as bigint) b from rendered""")
def render_stories(spark, d):
    return S.render_stories(K.stories(spark, d), K.books(spark, d),
                            K.sources(spark, d)).select(*S.STORY_COLUMNS)


@query("fetch_stories", f"""with {K.STORIES},
asked as (select doc_id request_id, source, concat('B', doc_id//20) book,
    unnest([1001, 1002, 1003, 1004, 1003, 2002, 2003, 2004, 2005]) pos,
    unnest([0, 0, 0, 0, 0, 1, 1, 1, 1]) part
  from documents)
select request_id, source, book, title, address, cast(a as bigint) a, cast(b as bigint) b
from asked join rendered using (source, book)
where part = request_id % 2 and pos between a and b and a <> b""")
def fetch_stories(spark, d):
    book = F.concat(F.lit("B"), F.floor(F.col("doc_id") / 20).cast("string"))
    requests = K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), "source",
        F.when(F.col("doc_id") % 2 == 0, F.concat(book, F.lit(" 1,1-4.3")))
        .otherwise(F.concat(book, F.lit(" 2,2-5"))).alias("address"))
    rendered = S.render_stories(K.stories(spark, d), K.books(spark, d), K.sources(spark, d))
    return S.fetch_stories(requests, rendered).rows


_GREEK_WORDS = f"""trim(regexp_replace(lower(text), '[^{K.GREEK[0]}]+', ' ', 'g'))"""


@query("greek_betacode", f"""select doc_id, {_GREEK_WORDS} code from documents""")
def greek_betacode(spark, d):
    docs = K.documents(spark, d)
    accented = F.translate(K.greek(F.col("text")), "αω", "άὦ")
    return docs.select("doc_id", F.trim(squeeze(greek_to_betacode(accented))).alias("code"))


@query("verse_dictionary", f"""with {K.VERSES},
words as (select distinct id, unnest(string_split({_GREEK_WORDS}, ' ')) w from verses),
dict as (select distinct unnest(string_split({_GREEK_WORDS}, ' ')) w from benchmark)
select words.id request_id, words.w topic, 'L' || dict.w word, 'of  ' || dict.w meaning,
  'P' || dict.w parse, coalesce('F' || dict.w || '|G' || dict.w, '') forms
from words left join dict on words.w = dict.w
where words.w <> '' and not (dict.w is not null and length(dict.w) = 7)""")
def verse_dictionary(spark, d):
    corpus = K.verses(spark, d).withColumn("text", K.greek(F.col("text")))
    rows = D.verse_dictionary(verse_requests(spark, d), corpus, K.dictionary(spark, d)).rows
    return rows.withColumn("forms", F.array_join("forms", "|"))


@query("dictionary_entries", f"""with
dict as (select distinct unnest(string_split({_GREEK_WORDS}, ' ')) w from benchmark)
select w topic, 'L' || w word, 'of  ' || w meaning, 'P' || w parse, 'F' || w || '|G' || w forms
from dict where w <> '' and length(w) <> 7""")
def dictionary_entries(spark, d):
    return D.parse_entries(K.dictionary(spark, d)).rows.select(
        "topic", "word", "meaning", "parse", F.array_join("forms", "|").alias("forms"))


@query("verse_metadata", f"""with {K.VERSES}
select id request_id, id verse_id, '3056|' || verse s, book m from verses""")
def verse_metadata(spark, d):
    text = F.concat(F.lit("<S>3056</S> "), F.col("text"), F.lit(" <m>"), F.col("book"),
                    F.lit("</m><S>"), F.col("verse").cast("string"), F.lit("</S>"))
    rows = L.verse_metadata(verse_requests(spark, d), K.verses(spark, d).withColumn("text", text))
    return rows.select("request_id", "verse_id", F.array_join("metadata.S", "|").alias("s"),
                       F.array_join("metadata.m", "|").alias("m"))


@query("sources_by_language", f"""with {K.VERSES}
select language, string_agg(source, ',' order by source) names
from (select distinct language, source from verses) group by 1""")
def sources_by_language(spark, d):
    return L.sources_by_language(K.sources(spark, d)).select(
        "language", F.array_join("names", ",").alias("names"))


@query("source_search", f"""with {K.VERSES}
select distinct language, source as name, case when source_number % 2 = 0
    then 'Edition of ' || language else '' end description_short
from verses where contains(lower(source || ' ' || case when source_number % 2 = 0
    then 'Edition of ' || language else '' end), 'of e')""")
def source_search(spark, d):
    rows = K.sources(spark, d).withColumn("description_short", F.when(
        F.col("source_number") % 2 == 0, F.concat(F.lit("Edition of "), "language")))
    return L.list_sources(rows, F.lit("OF E"))




def _first_verses(spark, d):
    """A request for the first verse of each document's first chapter, whether there is one."""
    return K.documents(spark, d).select(
        F.col("doc_id").alias("request_id"), A.verse_id(
            F.col("lang"), F.col("source_number"), F.col("book_number"), F.lit(1), F.lit(1))
        .alias("verse_id"))


@query("commentaries_from_index", f"""with {K.VERSES},
commentaries as (select language, source_number, book_number, chapter cf, verse vf,
    chapter + length(text) % 3 ct, verse + 5 vt, substr(text,1,3) marker, text
  from verses where length(text) % 11 = 0)
select d.doc_id request_id, c.marker, c.text, c.cf chapter_from, c.vf verse_from
from documents d join commentaries c on c.language = d.lang
  and c.source_number = d.doc_id % 20 and c.book_number = d.doc_id // 20
where 1001 between 1000 * c.cf + c.vf and 1000 * c.ct + c.vt""")
def commentaries_from_index(spark, d):
    """The index is built, stored and asked."""
    path = shared_dir(spark, "commentary-index")
    store_index(C.commentary_index(K.commentaries(spark, d)),
                ["language", "source_number", "book_number"], "language", path)
    return C.fetch_commentaries(_first_verses(spark, d), spark.read.parquet(path)).rows


@query("stories_from_index", f"""with {K.STORIES}
select doc_id request_id, d.source, r.book, r.title, r.address, cast(r.a as bigint) a,
  cast(r.b as bigint) b
from documents d join rendered r on r.source = d.source and r.book = concat('B', d.doc_id // 20),
  (values (1002), (1003)) p(pos)
where pos between r.a and r.b and r.a <> r.b""")
def stories_from_index(spark, d):
    """The index is built, stored and asked."""
    path = shared_dir(spark, "story-index")
    rendered = S.render_stories(K.stories(spark, d), K.books(spark, d), K.sources(spark, d))
    store_index(S.story_index(rendered), ["source", "book"], "source", path)
    requests = K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), "source", F.concat(
            F.lit("B"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit(" 1,2-3"))
        .alias("address"))
    return S.fetch_stories(requests, spark.read.parquet(path)).rows
