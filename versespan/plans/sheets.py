"""Sheet documents, upserts, clean-up, saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from versespan.functions import sheet_json as J
from versespan.operators import sheets as S
from versespan.plans import corpus as K
from versespan.plans.registry import query
from versespan.session import shared_dir
from versespan.streaming import sheets as T


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def conversation_sheets(spark, d):
    """A sheet per eight turns: user turns are notes, assistant turns pericopes.

    Every third conversation gives bare lists, and every fifth an item that does not decode.
    However long a conversation is, no sheet holds more than its eight turns.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = (F.when(F.col("role") == "user", "note")
            .when(F.col("role") == "assistant", "pericope").otherwise("other"))
    item = F.struct(
        F.when((conv % 5 == 4) & (turn == 1), F.lit(None)).otherwise(kind).alias("kind"),
        F.concat(F.lit("B"), (conv % 40).cast("string"), F.lit(" 1,"),
                 (turn + 1).cast("string"), F.lit("-")).alias("address"),
        F.when(turn % 7 == 6, "").otherwise(F.concat(
            F.lit("src"), ((conv + turn) % 20).cast("string"))).alias("source"),
        F.col("text").alias("content"))
    block = F.floor(turn / 8).alias("block")
    items = K.table(spark, d, "conversations").groupBy("conv_id", block).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))),
        lambda r: r["i"]).alias("items"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(
        F.lit("Sheet "), F.col("conv_id").cast("string")))
    data = F.when(F.col("conv_id") % 3 == 0, F.to_json("items")).otherwise(
        F.to_json(F.struct(title.alias("title"), "items")))
    sheet_id = F.concat_ws("-", "conv_id", "block")
    return items.select(sheet_id.alias("id"), data.alias("data"),
                        F.current_timestamp().alias("created_at"))


# Decoded items; sheets with a bad item are empty, and empty sheets take the defaults.
SHEET_ITEMS = """
talk as (select *, turn // 8 block, conv_id || '-' || turn // 8 sheet_id from conversations),
broken as (select sheet_id from talk where conv_id % 5 = 4 and turn = 1),
decoded as (select sheet_id, conv_id, turn, role, text, row_number() over (
    partition by sheet_id order by turn) - 1 pos from talk
  where sheet_id not in (select sheet_id from broken) and role in ('user', 'assistant')),
titled as (select distinct sheet_id,
    case when conv_id % 3 <> 0 and conv_id % 2 = 0
          and sheet_id not in (select sheet_id from broken)
         then 'Sheet ' || conv_id else '' end title from talk),
items as (select t.sheet_id, t.title, cast(pos as int) pos,
    case role when 'user' then 'note' else 'pericope' end kind,
    case role when 'user' then '' else 'B' || conv_id % 40 || ' 1,' || turn + 1 || '-' end address,
    case when role = 'user' or turn % 7 = 6 then '' else 'src' || (conv_id + turn) % 20 end as source,
    case role when 'user' then text else '' end content, conv_id % 40 book_number, turn + 1 lo
  from decoded join titled t using (sheet_id)
  union all
  select t.sheet_id, t.title, p, 'pericope', 'J 3,16-17', s, '', -1, 0
  from titled t, (values (0, 'NVUL'), (1, 'NA28'), (2, 'BT_03'), (3, 'TRO+')) x(p, s)
  where t.sheet_id not in (select sheet_id from decoded))"""


@query("sheet_decode", f"""with {SHEET_ITEMS.lstrip()}
select sheet_id, title, pos, kind, address, source, content from items""")
def sheet_decode(spark, d):
    return S.sheet_items(conversation_sheets(spark, d))


@query("sheet_encode", f"""with {SHEET_ITEMS.lstrip()}
select sheet_id, title, pos, kind, address, source, content from items where book_number >= 0""")
def sheet_encode(spark, d):
    decoded = S.decode_sheets(conversation_sheets(spark, d))
    again = decoded.select("id", J.encode_sheet(F.col("title"), F.col("items")).alias("data"))
    return S.decode_sheets(again).select(
        F.col("id").alias("sheet_id"), "title", F.posexplode("items").alias("pos", "i")).select(
        "sheet_id", "title", "pos", "i.*")


HYDRATED = f"""with {K.VERSES}, {SHEET_ITEMS.lstrip()},
shown as (select * from items where kind = 'note' or (address <> '' and source <> '')),
rows as (select i.sheet_id, i.title, i.pos, i.kind, i.address, i.source, i.content,
    v.id verse_id, v.chapter, v.verse, v.text
  from shown i left join verses v on i.kind = 'pericope' and v.source = i.source
    and v.book_number = i.book_number and v.chapter = 1 and v.verse >= i.lo)"""


@query("hydrate_sheets", f"""{HYDRATED}
select sheet_id, pos, kind, address, source, content, verse_id, text from rows""")
def hydrate_sheets(spark, d):
    rows = S.hydrate_sheets(conversation_sheets(spark, d), K.verses(spark, d),
                            K.books(spark, d), K.chapters(spark, d))
    return rows.select("sheet_id", "pos", "kind", "address", "source", "content", "verse_id",
                       "text")


def _changes(spark, d):
    return K.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("props").alias("data"),
        F.col("ts").cast("timestamp").alias("ts"))


_UPSERTED = f"""select cast(user_id as varchar) id, arg_max(props, (ts, props)) as data,
  case when user_id % 2 = 0 then '2023-12-31 00:00:00.000000'
       else {_SQL_STAMP.format('min(ts)')} end created_at
from events group by user_id"""


@query("sheet_upsert", _UPSERTED + """
union all select 'kept' || customer.c_custkey, '{}', '2023-12-31 00:00:00.000000' from customer""")
def sheet_upsert(spark, d):
    users = K.table(spark, d, "events").select("user_id").distinct().filter("user_id % 2 = 0")
    old = users.select(F.col("user_id").cast("string").alias("id")).unionByName(
        K.table(spark, d, "customer").select(
            F.concat(F.lit("kept"), F.col("c_custkey").cast("string")).alias("id")))
    target = old.select("id", F.lit("{}").alias("data"),
                        F.lit("2023-12-31").cast("timestamp").alias("created_at"))
    return S.upsert_sheets(target, _changes(spark, d)).withColumn(
        "created_at", _stamp("created_at"))


@query("stream_upsert_sheets", f"""select cast(user_id as varchar) id,
  arg_max(props, (ts, props)) as data, {_SQL_STAMP.format('min(ts)')} created_at
from events group by user_id""")
def stream_upsert_sheets(spark, d):
    schema = K.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option(
        "pathGlobFilter", "events.parquet").parquet(d)
    changes = stream.select(F.col("user_id").cast("string").alias("id"),
                            F.col("props").alias("data"), F.col("ts").cast("timestamp")
                            .alias("ts"))
    root = shared_dir(spark, "sheet-stream")
    T.stream_upsert_sheets(changes, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return T.current_sheets(spark, f"{root}/table").withColumn(
        "created_at", _stamp("created_at"))


@query("fetch_sheets", """select cast(event_id as varchar) id, props as data
from events where event_id in (select doc_id from labels)""")
def fetch_sheets(spark, d):
    sheets = K.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("data"))
    return S.fetch_sheets(sheets, K.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("id")))


def _event_sheets(spark, d):
    n = F.col("event_id") % 4
    data = (F.when(n == 0, '{"title": "  "}').when(n == 1, F.col("props"))
            .when(n == 2, '[1]').otherwise('{"title": " x"}'))
    return K.table(spark, d, "events").select(
        F.col("event_id").alias("id"), data.alias("data"),
        F.col("ts").cast("timestamp").alias("created_at"))


_AS_OF = "2024-01-31"


@query("sheet_cleanup", f"""select event_id id, {_SQL_STAMP.format('ts')} created_at from events
where not (event_id % 4 <> 3 and ts < timestamp '{_AS_OF}' - interval 7 days)""")
def sheet_cleanup(spark, d):
    kept = S.cleanup_sheets(_event_sheets(spark, d), F.lit(_AS_OF).cast("timestamp")).kept
    return kept.select("id", _stamp("created_at").alias("created_at"))


@query("sheet_cleanup_count", f"""select cast(count(*) as int) removed from events
where event_id % 4 <> 3 and ts < timestamp '{_AS_OF}' - interval 7 days""")
def sheet_cleanup_count(spark, d):
    return S.cleanup_sheets(_event_sheets(spark, d), F.lit(_AS_OF).cast("timestamp")).removed


_SAVED = f"""with s as (select user_id, max(ts) ts, arg_max(event_id, ts) event_id
  from events where user_id not in (select doc_id from labels where quality = 0) group by 1)
select cast(user_id as varchar) sheet_id,
  case event_id % 3 when 0 then 'T' || event_id else '' end title,
  {_SQL_STAMP.format('ts')} saved_at, case event_id % 3 when 1 then 2 else 0 end item_count
from s"""


def _saved(spark, d):
    n, event = F.col("event_id") % 3, F.col("event_id").cast("string")
    data = (F.when(n == 0, F.concat(F.lit('{"title": "T'), event, F.lit('", "items": 3}')))
            .when(n == 1, '{"title": 7, "items": [{}, {}]}').otherwise("[]"))
    saves = K.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("sheet_id"), _stamp("ts").alias("saved_at"),
        data.alias("data"))
    gone = K.table(spark, d, "labels").filter("quality = 0").select(
        F.col("doc_id").cast("string").alias("sheet_id"))
    return S.saved_sheets(saves, gone)


@query("saved_sheets", _SAVED)
def saved_sheets(spark, d):
    return S.most_recent_first(_saved(spark, d))


@query("saved_sheet_count", f"select count(*) saved from ({_SAVED})")
def saved_sheet_count(spark, d):
    return S.saved_count(_saved(spark, d))


@query("source_fill", """select conv_id, turn, coalesce(last_value(
    case when role = 'assistant' then 'src' || turn end ignore nulls) over (
    partition by conv_id order by turn rows between unbounded preceding and 1 preceding),
  'NVUL') source_above from conversations""")
def source_fill(spark, d):
    items = K.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", F.concat(
            F.lit("src"), F.col("turn").cast("string"))).alias("source"))
    return S.fill_source(items, ["conv_id"], "turn").select("conv_id", "turn", "source_above")


@query("expand_batch", r"""with p as (select doc_id, source,
  regexp_replace(unnest(string_split(replace(text, '. ', ';'), ';')), '^\s+|\s+$', '', 'g') address,
  generate_subscripts(string_split(replace(text, '. ', ';'), ';'), 1) i from documents)
select doc_id input_id, source, cast(row_number() over (partition by doc_id order by i) - 1 as int) pos, address
from p where address <> ''""")
def expand_batch(spark, d):
    inputs = K.documents(spark, d).select(
        F.col("doc_id").alias("input_id"), "source",
        F.replace("text", F.lit(". "), F.lit(";")).alias("batch"))
    return S.expand_batch(inputs)


@query("batch_requests", """with i as (select conv_id, turn, role, coalesce(last_value(
    case when role = 'assistant' then 'src' || (conv_id + turn) % 20 end ignore nulls) over (
    partition by conv_id order by turn rows between unbounded preceding and 1 preceding),
  'NVUL') as source from conversations)
select conv_id * 1000 + turn input_id, source, cast(p as int) pos,
  'B' || conv_id % 40 || ' ' || a as address
from i, (values (0, '1,1'), (1, '1,2-3')) x(p, a) where role = 'user'""")
def batch_requests(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    talk = K.table(spark, d, "conversations")
    items = talk.filter("role = 'assistant'").select(
        conv.alias("sheet_id"), turn.alias("pos"), F.lit("pericope").alias("kind"),
        F.concat(F.lit("src"), ((conv + turn) % 20).cast("string")).alias("source"))
    book = F.concat(F.lit("B"), (conv % 40).cast("string"))
    inputs = talk.filter("role = 'user'").select(
        (conv * 1000 + turn).alias("input_id"), conv.alias("sheet_id"), turn.alias("at"),
        F.concat(book, F.lit(" 1,1; ;"), book, F.lit(" 1,2-3;")).alias("batch"))
    return S.batch_requests(inputs, items)


@query("sheet_ids", """select event_id, event_id % 3 <> 0 as valid from events""")
def sheet_ids(spark, d):
    event = F.lpad(F.col("event_id").cast("string"), 12, "0")
    version = F.when(F.col("event_id") % 3 == 0, "9").otherwise("4")
    sheet_id = F.concat(F.lit("0Aa00000-0000-"), version, F.lit("000-b000-"), event)
    return K.table(spark, d, "events").select("event_id", J.is_sheet_id(sheet_id).alias("valid"))


@query("sheet_snapshot", f"""with c as (
  select cast(user_id as varchar) id, ts, event_id % 3 batch_id, case event_id % 4
    when 0 then '{{"title": "  "}}' when 1 then props when 2 then '[1]' else '{{"title": " x"}}' end as data
  from events),
s as (select id, arg_max(data, (ts, batch_id, data)) as data, min(ts) ts from c group by id)
select id, data, {_SQL_STAMP.format('ts')} created_at from s
where not (data <> '{{"title": " x"}}' and ts < timestamp '{_AS_OF}' - interval 7 days)""")
def sheet_snapshot(spark, d):
    """Two batches are folded, one of them comes again, a third follows and is folded with the
    clean-up; the table is read from the snapshot."""
    root = f"{shared_dir(spark, 'sheet-snapshot')}/table"
    changes = _event_sheets(spark, d).join(
        K.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), "id").select(
        F.col("user_id").cast("string").alias("id"), "data", F.col("created_at").alias("ts"),
        (F.col("id") % 3).alias("batch"))

    def write(batch):
        T.write_changes(changes.filter(F.col("batch") == batch).drop("batch"), root, batch)

    write(0)
    write(1)
    T.fold(spark, root)
    write(1)
    write(2)
    T.fold(spark, root, F.lit(_AS_OF).cast("timestamp"))
    return T.current_sheets(spark, root).withColumn("created_at", _stamp("created_at"))
