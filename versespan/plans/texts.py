"""Text expressions over whole pages, names and search strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.functions import text as X
from versespan.functions.core import lenient_int
from versespan.operators import search as Q
from versespan.plans import corpus as K
from versespan.plans.registry import query
from versespan.sources.files import extract_links


def pages(spark, d):
    return K.spread(K.table(spark, d, "pages").select("page_id", "html"), "page_id")


def _rewrite(column: str, pattern: str, replacement: str = "", flags: str = "g") -> str:
    pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''")
    return f"regexp_replace({column}, '{pattern}', '{replacement}', '{flags}')"


def _fold(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        column = _rewrite(column, pattern, replacement)
    return column


def _without_elements(column: str, tags: tuple[str, ...], passes: int = 12) -> str:
    """DuckDB has no back-references, so each tag is an alternative; passes exceed nesting."""
    pattern = "(?i)" + "|".join(f"<{t}>[^<>]*</{t}>" for t in tags)
    for _ in range(passes):
        column = _rewrite(column, pattern)
    return column


_SPACES = r"[\s\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
_NOT_SPACE = _SPACES.replace("[", "[^", 1)
_FORMAT = "(?i)</?(?:strong|b|br|div|pb|t)[^>]*>"
_PAGE_TAGS = ("b", "i", "em", "p", "li", "a", "title", "style", "h1", "ul")


def _page_query(name: str, sql: str, column: Callable) -> None:
    @query(name, f"select page_id, {sql} as text from pages")
    def plan(spark, d):
        return pages(spark, d).select("page_id", column(F.col("html")).alias("text"))


_page_query("text_without_format", _rewrite("html", _FORMAT), X.text_without_format)
_page_query("text_without_metadata",
            _rewrite(_without_elements("html", _PAGE_TAGS), _SPACES + "+", " "),
            lambda x: X.text_without_metadata(x, _PAGE_TAGS))
_page_query("raw_text", _rewrite(_rewrite(_without_elements(
    _rewrite("html", _FORMAT), ("S", "m", "f", "n", "h", "e")), _SPACES + "+", " "), "</?(?:J|i)>"), X.raw_text)
_page_query("strip_tags_scan", f"replace({_rewrite('html', '<[^>]*(?:>|$)')}, '>', '')",
            X.strip_tags_scan)
_page_query("strip_sm_tags", _fold("html", [(r"(?i)</?s\b[^>]*>", ""), (r"(?i)</?m\b[^>]*>", "")]),
            X.strip_sm_tags)
_page_query("print_clean", "trim(" + _fold("html", [
    (r"<[a-zA-Z]+\s*/>", ""), *[(f"<{t}>[^<]*</{t}>", "") for t in ("f", "e", "n", "m", "S")],
    ("<[^>]+>", ""), (r"\s+", " ")]) + ")", X.print_clean)


def _decoded(column: str) -> str:
    column = _fold(column, [(r"(?s)<!--.*?(?:-->|$)", ""), (r"</?[A-Za-z!?][^>]*(?:>|$)", "")])
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&nbsp;", "chr(160)"),
                       ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&mdash;", "chr(8212)"), ("&amp;", "'&'")):
        column = f"replace({column}, '{name}', {char})"
    return "trim(" + _rewrite(column, r"[\s\x{a0}]+", " ") + ")"


_page_query("html_to_text", _decoded("html"), X.html_to_text)


@query("collect_tags", f"""with c as (
  select page_id, replace(replace({_rewrite('html', _FORMAT)}, '<i>', '['), '</i>', ']') t
  from pages),
m as (select page_id,
  generate_subscripts(regexp_extract_all(t, '<[A-Za-z][A-Za-z0-9]*>[^<]+</[A-Za-z][A-Za-z0-9]*>'), 1) i,
  unnest(regexp_extract_all(t, '<[A-Za-z][A-Za-z0-9]*>[^<]+</[A-Za-z][A-Za-z0-9]*>')) e from c),
g as (select page_id, i, regexp_extract(e, '^<([A-Za-z0-9]+)>', 1) tag,
  regexp_extract(e, '</([A-Za-z0-9]+)>$', 1) closing,
  regexp_extract(e, '^<[^>]+>([^<]+)<', 1) as value from m)
select page_id, tag, cast(row_number() over (partition by page_id, tag order by i) - 1 as int) pos, value
from g where tag = closing""")
def collect_tags(spark, d):
    tags = pages(spark, d).select("page_id", F.explode(X.collect_tags(F.col("html")))
                                  .alias("tag", "_values"))
    return tags.select("page_id", "tag", F.posexplode("_values").alias("pos", "value"))


@query("link_extract", """with m as (select page_id,
  generate_subscripts(regexp_extract_all(html, 'href="/([^"]+)"', 1), 1) - 1 pos,
  unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) as name from pages)
select page_id, cast(pos as int) pos, name from m""")
def link_extract(spark, d):
    return extract_links(pages(spark, d), pattern='href="/([^"]+)"')


@query("slug_names", """with s as (select c_custkey, c_acctbal,
  trim(regexp_replace(lower(c_mktsegment || ' & ' || c_name), '[^a-z0-9]+', '-', 'g'), '-') slug
  from customer)
select c_custkey, case when c_acctbal < 0 then 'sheet-' || c_custkey || '.md'
  else slug || '-' || c_custkey || '.md' end file_name, slug from s""")
def slug_names(spark, d):
    title = F.concat("c_mktsegment", F.lit(" & "), "c_name")
    shown = F.when(F.col("c_acctbal") < 0, F.lit("***")).otherwise(title)
    return K.table(spark, d, "customer").select(
        "c_custkey", X.export_name(shown, F.col("c_custkey").cast("string")).alias("file_name"),
        X.slugify(title).alias("slug"))


@query("file_safe_names", """select o_orderkey,
  'J_' || o_custkey || '_' || o_orderkey % 90 || '_' || o_orderpriority file_name,
  strftime(o_orderdate, '%Y-%m-%d') saved_on
from (select * replace (translate(o_orderpriority, ' ,:.', '____') as o_orderpriority)
      from orders)""")
def file_safe_names(spark, d):
    address = F.concat(F.lit("J "), F.col("o_custkey").cast("string"), F.lit(","),
                       (F.col("o_orderkey") % 90).cast("string"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return K.table(spark, d, "orders").select(
        "o_orderkey", X.file_safe(address, F.col("o_orderpriority")).alias("file_name"),
        X.date_prefix(stamp).alias("saved_on"))


@query("lenient_integers", """select l_orderkey, l_linenumber,
  case l_linenumber % 5 when 0 then l_partkey when 1 then -l_partkey
                        when 2 then l_partkey end as number from lineitem""")
def lenient_integers(spark, d):
    n, part = F.col("l_linenumber") % 5, F.col("l_partkey").cast("string")
    text = (F.when(n == 0, part).when(n == 1, F.concat(F.lit(" -"), part))
            .when(n == 2, F.concat(part, F.lit("abc"))).when(n == 3, F.lit(" "))
            .otherwise(F.concat(F.lit("x"), part)))
    return K.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", lenient_int(text).cast("bigint").alias("number"))


_PIN = rf"~({_NOT_SPACE}+(?:{_SPACES}+\d+(?:[,:][\d\-.]+)?)?)"


@query("parse_search_phrases", rf"""with s as (select doc_id,
  case doc_id % 4 when 0 then '@' || source || ' ~B' || doc_id || ' 3,10- ' || text
                  when 1 then text || ' @' || source when 2 then '~B' || doc_id || ' 2'
                  else text end x from documents)
select doc_id request_id,
  coalesce(nullif(regexp_extract(x, '@({_NOT_SPACE}+)', 1), ''), 'PAU') as source,
  nullif(regexp_extract(x, '{_PIN}', 1), '') as address,
  nullif(trim(regexp_replace(regexp_replace(x, '@{_NOT_SPACE}+{_SPACES}*', '', 'g'),
                             '{_PIN}', '', 'g')), '') as phrase from s""")
def parse_search_phrases(spark, d):
    n, doc, text = F.col("doc_id") % 4, F.col("doc_id").cast("string"), F.col("text")
    search = (
        F.when(n == 0, F.concat(F.lit("@"), "source", F.lit(" ~B"), doc, F.lit(" 3,10- "), text))
        .when(n == 1, F.concat(text, F.lit(" @"), "source"))
        .when(n == 2, F.concat(F.lit("~B"), doc, F.lit(" 2"))).otherwise(text))
    requests = K.documents(spark, d).select(F.col("doc_id").alias("request_id"),
                                            search.alias("search"))
    return Q.parse_phrases(requests)


@query("range_labels", f"""with {K.VERSES},
b as (select doc_id request_id, any_value(book) book, min(1000000 * chapter + verse) lo,
        max(1000000 * chapter + verse) hi from verses group by 1)
select request_id, case when lo = hi then concat(book, ' ', lo // 1000000, ',', lo % 1000000)
  when lo // 1000000 = hi // 1000000
    then concat(book, ' ', lo // 1000000, ',', lo % 1000000, chr(8211), hi % 1000000)
  else concat(book, ' ', lo // 1000000, ',', lo % 1000000, chr(8201), chr(8211), chr(8201),
              hi // 1000000, ',', hi % 1000000) end as label from b""")
def range_labels(spark, d):
    place = F.struct("chapter", "verse")
    ends = K.verses(spark, d).groupBy(F.col("doc_id").alias("request_id"), "book").agg(
        F.min(place).alias("lo"), F.max(place).alias("hi"))
    return ends.select("request_id", A.range_label(
        F.col("book"), F.col("lo.chapter"), F.col("lo.verse"), F.col("hi.chapter"),
        F.col("hi.verse")).alias("label"))
