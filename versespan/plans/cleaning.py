"""Correction rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from versespan.operators import errata
from versespan.operators import errata_rules as R
from versespan.plans import corpus as K
from versespan.plans.registry import query

_LANGUAGES = ("grc", "pl", "la")

# Something for every rule to act on, put in front of each page.
_TRIGGERS = ("<CM>, <<x>> &lt;a.Bc,De> <e>E</e><small a>s</small><LXX x>l</LXX><WW><S>0</S> "
             "κυριου <S>2962</S> <m>> <div x>d</div><b>b</b> (aside) &gt; z.Ż <CM> ")


def _errata_sql() -> str:
    """The rules as statements of their own, one after another, per language."""
    def steps(text: str, *more: str) -> str:
        for step in more:
            text = step.replace("TEXT", text)
        return text

    grc = steps(
        "t", "case when regexp_matches(TEXT, '</?div') then regexp_replace(TEXT, "
             "'<[^>]*div[^>]*>', '', 'g') else TEXT end",
        "regexp_replace(TEXT, '</?e>', '', 'g')", "regexp_replace(TEXT, '</?small[^>]*>', '', 'g')",
        "regexp_replace(TEXT, '</?LXX[^>]*>', '', 'g')", "replace(TEXT, '<WW>', '')",
        "replace(TEXT, '<S>0</S>', '')",
        "replace(TEXT, 'κυριου <S>2962</S> <m>>', 'κυριου <S>2962</S> <m>N-GSM</m>')",
        "replace(TEXT, '>>', '>')", "replace(TEXT, '<<', '<')")
    la = ("case when regexp_matches(t, '[.,:;!?][A-Zaz]') then regexp_replace(t, "
          "'([.,:;!?])([A-Za-z])', '\\1 \\2', 'g') else t end")
    return f"""with r as (select page_id, ['grc', 'pl', 'la'][page_id % 3 + 1] as language,
  18 - page_id % 2 source_number, '{_TRIGGERS}' || html as t from pages),
p1 as (select *, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '</?e>', '', 'g') u
  from r where language = 'pl'),
p2 as (select *, replace(case when source_number = 18 and regexp_matches(u, '(?s)\\(.*\\)')
  then regexp_replace(u, '\\s*\\([^)]*\\)', '', 'g') else u end, '<S>0</S>', '') v from p1),
p3 as (select *, case when contains(v, '<CM>') then substr(v, 1, strpos(v, '<CM>') - 1) || '<n>'
  || substr(v, strpos(v, '<CM>') + 4) || '</n>' else v end w from p2),
p4 as (select *, regexp_replace(replace(replace(replace(replace(w, '>>', '>'), '<<', '<'),
  '&gt;', '›'), '&lt;', '‹'), '([.,;!?])([A-ZĄĆĘŁŃÓŚŹŻ])', '\\1 \\2', 'g') x from p3),
p5 as (select *, array_to_string(list_transform(regexp_extract_all(x, '<[^<>]*>|[^<>]+|[<>]'),
  lambda y: case when y = '>' then '›' else y end), '') z from p4)
select page_id, language, {grc} as text from r where language = 'grc'
union all select page_id, language, {la} from r where language = 'la'
union all select page_id, language, z from p5"""


@query("errata_global", _errata_sql())
def errata_global(spark, d):
    language = F.element_at(F.array(*[F.lit(x) for x in _LANGUAGES]),
                            (F.col("page_id") % 3 + 1).cast("int"))
    pages = K.spread(K.table(spark, d, "pages").select("page_id", "html"), "page_id")
    rows = pages.select(
        "page_id", F.col("page_id").cast("string").alias("id"), language.alias("language"),
        (18 - F.col("page_id") % 2).cast("int").alias("source_number"),
        F.concat(F.lit(_TRIGGERS), "html").alias("text"))
    return errata.apply_errata(rows).select("page_id", "language", "text")


# A text for each corrected verse, and what the corrections make of it.
_ROWS = (
    ("grc/47/140/5/9", "a <> 0</S> b", "a   b"),
    ("grc/7/490/5/24", "a <> b", "a  b"),
    ("grc/47/350/7/1", "a <x><E>Israel.<e><q> b <Q>><G>Ισραηλ<g><X> c", "a  b  c"),
    ("grc/47/110/2/35", "a <S0</S> b", "a  b"),
    ("grc/47/230/43/3", "a <W b", "a  b"),
    ("pl/12/470/18/11", "<Albowiem co zginęło>", "[Albowiem co zginęło]"),
    ("pl/19/550/2/7", "na <apostolstwo> b", "na [apostolstwo] b"),
    ("pl/12/470/6/33", "<Boga> b", "[Boga] b"),
    ("pl/12/480/7/8", "<dokonujecie co czynicie>", "[dokonujecie co czynicie]"),
    ("pl/12/490/13/35", "<nadejdzie chwila gdy>", "[nadejdzie chwila gdy]"),
    ("pl/12/730/16/15", "<Oto nie widziano>", "[Oto nie widziano]"),
    ("pl/5/290/23/10", "<jak nad Nilem>", "[jak nad Nilem]"),
    ("pl/5/290/59/17", "<jak odzienie> b", "[jak odzienie] b"),
    ("pl/12/490/10/42", "<mało albo> b", "[mało albo] b"),
    ("pl/12/500/10/13", "<najemnik ucieka> b", "[najemnik ucieka] b"),
    ("pl/12/470/18/15", "<przeciw tobie> b", "[przeciw tobie] b"),
    ("pl/5/640/1/12", "<ty zaś> <przyjmij do domu>", "[ty zaś] [przyjmij do domu]"),
    ("pl/5/290/40/7", "<Rzeczywiście trawą jest naród>", "[Rzeczywiście trawą jest naród]"),
    ("pl/5/290/28/1", "<urodzajnej doliny> b", "[urodzajnej doliny] b"),
    ("pl/12/480/10/24", "<tym co ufność>", "[tym co ufność]"),
    ("pl/5/290/22/14", "<mówi Pan Zastępów>", "[mówi Pan Zastępów]"),
    ("pl/12/500/6/47", "<we Mnie> b", "[we Mnie] b"),
    ("pl/5/290/32/19", "<Grad na nizinom>", "[Grad na nizinom]"),
    ("pl/5/290/36/11", "<Szebna i Joach> b", "[Szebna i Joach] b"),
    ("pl/1/10/1/1", "<> 0</S> <W <Boga>", "<> 0</S> <W <Boga>"),
)
_CASES = " ".join(f"when {i} then ('{row_id}', '{right}')"
                  for i, (row_id, _, right) in enumerate(_ROWS))


@query("errata_rows", f"""with r as (select page_id, url,
  case page_id % {len(_ROWS)} {_CASES} end as e from pages)
select page_id, e[1] as id, e[2] || ' ' || url as text from r""")
def errata_rows(spark, d):
    """Every corrected verse, with something for its corrections to act on."""
    fixture = F.array(*[F.struct(F.lit(row_id).alias("id"), F.lit(wrong).alias("text"))
                        for row_id, wrong, _ in _ROWS])
    rows = K.table(spark, d, "pages").select("page_id", "url", F.get(
        fixture, (F.col("page_id") % len(_ROWS)).cast("int")).alias("e")).select(
        "page_id", "e.id", F.concat("e.text", F.lit(" "), "url").alias("text"))
    only_rows = [stage for stage in R.STAGES if isinstance(stage[0], R.RowRule)]
    return errata.apply_errata(rows, only_rows)


@query("errata_exact", f"""with {K.VERSES}
select id, case when length(text) % 13 = 0 then replace(replace(text, split_part(text, ' ', 1),
  '[' || split_part(text, ' ', 1)), '[', '<<') else text end as text from verses""")
def errata_exact(spark, d):
    corpus = K.verses(spark, d).select("id", "text")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    listed = corpus.filter(F.length("text") % 13 == 0).select(
        F.col("id").alias("row_id"), F.explode(F.array(
            F.struct(F.lit(2).alias("seq"), F.lit("[").alias("find"),
                     F.lit("<<").alias("replacement")),
            F.struct(F.lit(1).alias("seq"), word.alias("find"),
                     F.concat(F.lit("["), word).alias("replacement")))).alias("r"))
    return errata.apply_row_rules(corpus, listed.select("row_id", "r.*"))


@query("repair_markers", f"""with {K.VERSES}
select id, ['grc', 'en', 'fr'][length(text) % 3 + 1] as language,
  case length(text) % 3 when 0 then case when chapter = 1 then address else 'm' || verse end
    when 1 then 'm' || verse else 'm' || chr(8201) || verse end marker from verses""")
def repair_markers(spark, d):
    n = F.length("text") % 3
    link = F.concat(F.lit('<span class="vuhead"><a href="B:1">'), "address",
                    F.lit("</a></span> "), "text")
    rows = K.verses(spark, d).select(
        "id", F.element_at(F.array(F.lit("grc"), F.lit("en"), F.lit("fr")), n + 1)
        .alias("language"),
        F.concat(F.lit("m "), F.col("verse").cast("string")).alias("marker"),
        F.when(F.col("chapter") == 1, link).otherwise(F.col("text")).alias("text"))
    return errata.repair_markers(rows).select("id", "language", "marker")
