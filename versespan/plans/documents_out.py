"""Documents for print and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from versespan.operators import export as E
from versespan.operators.joins import joined_parts
from versespan.plans import corpus as K
from versespan.plans.registry import query
from versespan.plans.sheets import HYDRATED, conversation_sheets
from versespan.plans.texts import _decoded


def lettered(number):
    """A book name without digits, as the export's address grammar needs."""
    return F.concat(F.lit("B"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))


SHARED = "src3"              # the one source name that several languages have


def own_source(language, source):
    """Source names of the export's fixture: one per language, but for the shared one."""
    return F.when(source == SHARED, source).otherwise(F.concat(source, F.lit("-"), language))


def lettered_verses(spark, d):
    return K.verses(spark, d).withColumn("book", lettered(F.col("book_number"))).withColumn(
        "source", own_source(F.col("language"), F.col("source")))


def document_source():
    return own_source(F.col("lang"), F.col("source")).alias("source")


def document_book():
    return lettered(F.floor(F.col("doc_id") / 20))


_BOOK = "concat('B', translate('' || {}, '0123456789', 'abcdefghij'))"


def export_requests(spark, d):
    """Each document asks for some verses of a chapter, a chapter, or the whole of its book."""
    form, book = F.col("doc_id") % 3, document_book()
    chapter = (1 + F.col("doc_id") % 4).cast("string")
    return K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(form == 0, F.concat(book, F.lit(" "), chapter, F.lit(",1.2-3.900-")))
        .when(form == 1, F.concat(book, F.lit(" "), chapter)).otherwise(book)
        .alias("address"), document_source())


# A source is read from the first language it is stored under.
_OWN = "case when {0}source = 'src3' then {0}source else {0}source || '-' || {0}{1} end"
STORED = K.VERSES + f""",
named as (select * replace ({_OWN.format('', 'language')} as source) from verses),
asked as (select doc_id, {_OWN.format('', 'lang')} as source from documents),
stored as (select v.* from named v semi join (
    select source, min(language) as language from named group by 1) f using (source, language))"""
_ASKED = """case d.doc_id % 3
   when 0 then v.chapter = 1 + d.doc_id % 4 and (v.verse <= 3 or v.verse >= 900)
   when 1 then v.chapter = 1 + d.doc_id % 4 else true end"""
_DOC = _BOOK.format("d.doc_id // 20") + """ || case d.doc_id % 3
   when 0 then ' ' || (1 + d.doc_id % 4) || ',1.2-3.900-'
   when 1 then ' ' || (1 + d.doc_id % 4) else '' end"""


@query("chapters_json", f"""with {STORED}
select d.doc_id request_id, d.source, {_BOOK.format('v.book_number')} book, v.book_name, {_DOC} address,
  cast(v.chapter as varchar) chapter, v.verse, v.text
from asked d join stored v on v.source = d.source and v.book_number = d.doc_id // 20
  and ({_ASKED})""")
def chapters_json(spark, d):
    rows = E.export_rows(export_requests(spark, d), lettered_verses(spark, d)).rows
    docs = joined_parts(E.export_documents(rows), ["request_id"])
    parsed = docs.select("request_id", F.from_json(
        "document", "source string, book string, book_name string, address string, "
        "chapters map<string, array<struct<verse:int, text:string>>>").alias("j"))
    return parsed.select("request_id", "j.source", "j.book", "j.book_name", "j.address",
                         F.explode("j.chapters").alias("chapter", "_v")).select(
        "request_id", "source", "book", "book_name", "address", "chapter",
        F.inline("_v").alias("verse", "text"))


@query("whole_book_json", f"""with {STORED}
select d.doc_id request_id, d.source, {_BOOK.format('v.book_number')} book, chapter,
  count(*) verses, cast(sum(length(text)) as bigint) chars
from asked d join stored v on v.source = d.source and v.book_number = d.doc_id // 20
group by all""")
def whole_book_json(spark, d):
    requests = K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), document_book().alias("address"), document_source())
    rows = E.export_rows(requests, lettered_verses(spark, d)).rows
    verses = F.from_json("verses", "array<struct<verse:int, text:string>>")
    chars = F.aggregate(verses, F.lit(0).cast("bigint"), lambda acc, v: acc + F.length(v["text"]))
    return E.export_chapters(rows).groupBy("request_id", "source", "book", "chapter").agg(
        F.sum(F.size(verses)).alias("verses"), F.sum(chars).alias("chars"))


@query("page_labels", f"""with {STORED},
b as (select d.doc_id request_id, any_value({_BOOK.format('v.book_number')}) book,
    min((chapter, verse)) lo, max((chapter, verse)) hi
  from asked d join stored v on v.source = d.source and v.book_number = d.doc_id // 20 group by 1)
select request_id, concat(book, ' ', lo[1], ',', lo[2], case
    when hi = lo then '' when hi[1] = lo[1] then chr(8211) || hi[2]
    else chr(8201) || chr(8211) || chr(8201) || hi[1] || ',' || hi[2] end) as label
from b""")
def page_labels(spark, d):
    requests = K.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), document_book().alias("address"), document_source())
    return E.page_labels(E.export_rows(requests, lettered_verses(spark, d)).rows)


@query("sheet_markdown", f"""{HYDRATED},
blocks as (select sheet_id, pos, any_value(title) title, case when any_value(kind) = 'note'
    then any_value(regexp_replace(regexp_replace(content, '(?i)</?s\\b[^>]*>', '', 'g'),
                                  '(?i)</?m\\b[^>]*>', '', 'g'))
    else '###### ' || any_value(address) || ' (' || any_value(source) || ')' ||
      coalesce(string_agg(case when verse_id is null then null else chr(10) || '- <sup>' || verse
        || '</sup>' || case when {_decoded('text')} = '' then '' else ' ' || {_decoded('text')} end
        end, '' order by chapter, verse, verse_id), '') end as block
  from rows group by sheet_id, pos),
bodies as (select sheet_id, string_agg(block, chr(10) || chr(10) order by pos) body
  from blocks group by 1)
select t.sheet_id, t.title, case when t.title = '' then coalesce(body, '')
  else '# ' || t.title || coalesce(chr(10) || chr(10) || body, '') end as document
from titled t left join bodies using (sheet_id)""")
def sheet_markdown(spark, d):
    parts = E.sheet_markdown(conversation_sheets(spark, d), K.verses(spark, d),
                             K.books(spark, d), K.chapters(spark, d))
    return joined_parts(parts, ["sheet_id", "title"])
