"""Rule-driven correction of verses, commentaries and references.

Corrections run before the per-language tables are united, so every reader of the corpus
sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.functions import text as X
from versespan.functions.core import let
from versespan.operators import errata_rules as R
from versespan.operators.joins import small_side


def _apply(rule: R.Rule, text: Column) -> Column:
    for find, replacement in rule.steps:
        if rule.first_only:
            pattern = re.escape(find) if rule.literal else find
            text = F.regexp_replace(text, f"(?s)^(.*?){pattern}", "$1" + replacement)
        elif rule.literal:
            text = F.replace(text, F.lit(find), F.lit(replacement))
        else:
            text = F.regexp_replace(text, find, replacement)
    if rule.hanging:
        runs = F.regexp_extract_all(text, F.lit("<[^<>]*>|[^<>]+|[<>]"), F.lit(0))
        text = F.array_join(F.transform(
            runs, lambda r: F.when(r == ">", rule.hanging).otherwise(r)), "")
    return F.concat(text, F.lit(rule.suffix)) if rule.suffix else text


def _gated(rule: R.Rule, source_number: Column) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        test = F.lit(True) if rule.gate is None else text.rlike(rule.gate)
        if rule.source_number is not None:
            test = test & (source_number == rule.source_number)
        return F.when(test, _apply(rule, text)).otherwise(text)

    return apply


def _row_stage(number: int) -> Callable[[Column], Column]:
    """The single-row rules of one stage, for rows that have any."""
    def apply(text: Column) -> Column:
        mine = F.filter("_rules", lambda r: r["stage"] == number)
        return F.when(F.col("_rules").isNull(), text).otherwise(F.aggregate(
            mine, text, lambda acc, r: F.replace(acc, r["find"], r["replacement"])))

    return apply


def _rule_stage(rules: Sequence[R.Rule]) -> Callable[[Column], Column]:
    return lambda text: corrected(text, F.col("language"), F.col("source_number"), rules)


def corrected(text: Column, language: Column, source_number: Column,
              rules: Sequence[R.Rule]) -> Column:
    """``text`` after ``rules`` in order, as one projection with one chain per language."""
    out = None
    for name in dict.fromkeys(rule.language for rule in rules):
        chain = text
        for rule in rules:
            if rule.language != name:
                continue
            if rule.gate is None and rule.source_number is None:
                chain = _apply(rule, chain)
            else:
                chain = let(chain, _gated(rule, source_number))
        out = F.when(language == name, chain) if out is None \
            else out.when(language == name, chain)
    return text if out is None else out.otherwise(text)


def apply_row_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Literal replacements ``(row_id, seq, find, replacement)`` in single rows, in order."""
    per_row = rules.groupBy(F.col("row_id").alias("id")).agg(F.array_sort(F.collect_list(
        F.struct("seq", "find", "replacement"))).alias("_rules"))
    fixed = F.aggregate("_rules", F.col("text"), lambda acc, r: F.replace(
        acc, r["find"], r["replacement"]))
    return rows.join(small_side(per_row), "id", "left").withColumn(
        "text", F.when(F.col("_rules").isNull(), F.col("text")).otherwise(fixed)
    ).drop("_rules").select(*rows.columns)


def apply_errata(verses: DataFrame, stages: Sequence[Sequence] = R.STAGES) -> DataFrame:
    """All stages in order: each is a tuple of rules or of single-row rules.

    The single-row rules of every stage arrive through one join on the row id.
    """
    spark = verses.sparkSession
    listed = [(rule.row_id, stage, seq, rule.find, rule.replacement)
              for stage, rules in enumerate(stages) for seq, rule in enumerate(rules)
              if isinstance(rule, R.RowRule)]
    rows = verses
    if listed:
        table = spark.createDataFrame(
            listed, "row_id string, stage int, seq int, find string, replacement string")
        per_row = table.groupBy(F.col("row_id").alias("id")).agg(F.array_sort(F.collect_list(
            F.struct("stage", "seq", "find", "replacement"))).alias("_rules"))
        rows = rows.join(F.broadcast(per_row), "id", "left")   # a module constant
    text = F.col("text")
    for number, rules in enumerate(stages):
        if rules:
            single = isinstance(rules[0], R.RowRule)
            text = let(text, _row_stage(number) if single else _rule_stage(rules))
    return rows.withColumn("text", text).select(*verses.columns)


def repair_markers(commentaries: DataFrame) -> DataFrame:
    """Markers read from the heading link, and thin spaces removed."""
    language = F.col("language")
    marker = F.when(language.isin(*R.MARKER_FROM_TEXT), X.repair_marker(
        F.col("marker"), F.col("text"))).otherwise(F.col("marker"))
    marker = F.when(language.isin(*R.MARKER_SPACING), X.without_thin_space(marker)) \
        .otherwise(marker)
    return commentaries.withColumn("marker", marker)


def add_missing_reference(refs: DataFrame) -> DataFrame:
    """Append the missing reference unless it is there already."""
    row = R.MISSING_REFERENCE
    new = refs.sparkSession.range(1).select(
        *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in refs.schema])
    present = refs
    for name in refs.columns:
        present = present.filter(F.col(name).eqNullSafe(F.lit(row.get(name)).cast("int")))
    found = new.withColumn("_there", F.lit(0)).unionByName(
        present.limit(1).withColumn("_there", F.lit(1)))
    absent = found.groupBy(*refs.columns).agg(F.max("_there").alias("_there")).filter(
        F.col("_there") == 0).drop("_there")
    return refs.unionByName(absent)
