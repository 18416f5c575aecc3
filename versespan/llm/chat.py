"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context, and its text alone
is trainable. Turns after the last reply (or a conversation without one) become one more
example without a trainable span, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Break every ``<|`` with a backslash. ``<`` + backslashes + ``|`` gets one more, so
    that :func:`unescape` gives the text back whatever it holds."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As :func:`escape`; the newline that would end the header is written ``%0A``."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")),
                            F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")),
                     F.lit("%25"), F.lit("%"))


def prefix_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text",
                    target: str = "assistant") -> DataFrame:
    """``conv_id, example, n_examples, target_turn, text, loss_start, loss_end``.

    ``example`` counts from 1 inside a conversation; ``loss_start`` and ``loss_end`` are code
    point offsets into ``text`` (end exclusive), NULL where nothing is trainable.

    Turns are put in order of turn, role, text (NULL turns first), so repeated turn numbers
    and repeated rows all stay. A NULL role or text is empty; rows with a NULL conversation
    id form one conversation. An empty reply gives an empty span. Other columns are ignored.
    An empty table gives no examples.

    The texts of all examples of a conversation grow with the square of its turns; that is
    what the expansion means. Only the conversation itself is held in one row, each example
    is cut from it when its row is made.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "text", head.alias("head"),
                       escape(F.col("text")).alias("body"))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + F.lit(len(END) + 1))
    so_far = Window.partitionBy("conv").orderBy("turn", "role", "text") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("stop", F.sum("chars").over(so_far)).withColumn(
        "number", F.count(F.lit(1)).over(so_far))
    body_stop = F.col("stop") - (len(END) + 1)
    span = F.struct("number", "turn", (body_stop - F.length("body")).alias("loss_start"),
                    body_stop.alias("loss_end"), "stop")
    nothing = F.lit(None).cast("bigint")
    rest = F.struct("number", F.lit(None).cast(turns.schema[turn].dataType).alias("turn"),
                    nothing.alias("loss_start"), nothing.alias("loss_end"), "stop")
    is_target = F.col("role") == target
    whole = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("number", F.concat(
            "head", "body", F.lit(END + "\n")).alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(is_target, span))).alias("targets"),
        F.max(F.when(is_target, F.col("number"))).alias("last_target"),
        F.max("number").alias("n"),
        F.max_by(rest, F.col("number")).alias("rest"))
    whole = whole.select(
        "conv",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("whole"),
        F.when(F.coalesce("last_target", F.lit(0)) < F.col("n"),
               F.concat("targets", F.array("rest"))).otherwise(F.col("targets")).alias("spans"))
    each = whole.select("conv", "whole", F.size("spans").alias("n_examples"),
                        F.posexplode("spans").alias("place", "span"))
    return each.select(
        F.col("conv").alias(conv_id), (F.col("place") + 1).alias("example"), "n_examples",
        F.col("span.turn").alias("target_turn"),
        F.col("whole").substr(F.lit(1), F.col("span.stop").cast("int")).alias("text"),
        F.col("span.loss_start").alias("loss_start"), F.col("span.loss_end").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), read back from it."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        content = piece.substr(F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(content, "\n", 1)
        body = content.substr(F.length(role) + 2, F.length(content))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What is trainable in a formatted text, unescaped."""
    return unescape(text.substr((start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the examples: its turns, what is trainable over all
    examples, and the characters written."""
    whole = F.when(F.col("example") == F.col("n_examples"), F.transform(
        read_turns(F.col("text")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = examples.select(
        F.col(conv_id).alias("conv"), "example", F.length("text").alias("chars"),
        F.coalesce(loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")),
                   F.lit("")).alias("loss"),
        whole.alias("turns"))
    read = read.select("conv", "example", "chars", "loss", F.size("turns").alias("n"),
                       F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("sha"))
    per = read.groupBy("conv").agg(
        F.max("n").cast("bigint").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                 lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").cast("bigint").alias("formatted_chars"))
    return per.select(
        F.col("conv").alias(conv_id), "n_turns", "turns_sha256",
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
