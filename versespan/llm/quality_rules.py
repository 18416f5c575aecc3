"""Quality rules: base counts, and divergence from language references, in DataFrame functions.

A document's character-class histogram and common-word histogram are compared with those of
the languages by Jensen-Shannon distance (base 2, so 0 to 1). The references are the mean
histograms of the documents of each language that pass the base rules, over the whole table.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.operators.joins import computed
from versespan.session import materialize

SPACE = r"\x20\x09-\x0D"
COMMON_WORDS = (
    "the of and to in a is that for it "                       # English
    "de la le et les des un du une est "                       # French
    "que el en los se del las con por para "                   # Spanish
    "der die und den von zu das mit sich ein").split()         # German
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CHARS = 200          # fewer characters: the character histogram says too little
MIN_JUDGED_WORDS = 100   # fewer words, common or not: the word histogram says too little
MAX_CHAR_DISTANCE = 0.28
LOW_SHARE = 0.05         # the word limit lies WORD_SPREADS times as far above the median distance
WORD_SPREADS = 3.0       # as the distance of this share lies below it,
LEAST_WORD_LIMIT = 0.2   # and not lower than chance alone brings a text of 100 words
DISTANCE_STEPS = 1000
MIN_DOCUMENTS = 20       # a language with fewer good documents has no reference of its own,
MIN_SHARE = 0.01         # unless they are this share of them all, as in small tables
CHAR_BINS = 7


def _kept_chars(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, ""))


def _spellings() -> list[str]:
    """The common words in capitals, small letters and mixtures of both."""
    return ["".join(x) for w in COMMON_WORDS for x in product(*[(c, c.upper()) for c in w])]


def rule_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``rule`` to each row: a struct of base counts and the two histograms.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``. NULL and empty texts have no words
    and empty histograms. Column names of the input can not clash: all is in ``rule``, which
    replaces a column of that name.
    """
    given = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in given.items()],
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = computed(rows, F.array_remove(F.split("text", f"[{SPACE}]+"), ""), "words")
    rows = computed(rows, F.filter(F.split("text", "\n"),
                                   lambda line: line.rlike(f"[^{SPACE}]")), "lines")
    hits = F.array_join(F.filter("words", lambda w: w.isin(_spellings())), "  ")
    rows = computed(rows, F.concat(F.lit(" "), F.lower(hits), F.lit(" ")), "hits")
    common = F.array(*[
        ((F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(f" {w} "), F.lit(""))))
         / (len(w) + 2)).cast("int") for w in COMMON_WORDS])
    total, body = F.length("text"), F.length(F.array_join("words", ""))
    classes = [_kept_chars(F.col("text"), x) for x in (
        "[^a-z]+", "[^A-Z]+", "[^0-9]+", "[^#*$%&|<>]+", r"[^.,;:!?'\"()\-]+")]
    counts = rows.select(
        *given.values(), F.size("words").cast("bigint").alias("n_words"), body.cast("bigint").alias("body"),
        (total - body).alias("blank"), F.array(*classes).alias("classes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("dup_lines"),
        common.alias("common"),
        F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
                    lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
        .alias("windows"))
    counts = computed(counts, F.struct(
        "n_words", F.col("body").alias("word_chars"),
        F.get("classes", F.lit(3)).cast("bigint").alias("n_symbols"),
        F.col("dup_lines").alias("n_dup_lines"),
        F.concat("classes", F.array(
            F.col("blank").cast("int"),
            (F.col("body") - F.aggregate("classes", F.lit(0), lambda a, x: a + x)).cast("int")))
        .alias("chars"),
        F.concat("common", F.array((F.col("n_words") - F.aggregate(
            "common", F.lit(0), lambda a, x: a + x)).cast("int"))).alias("common")), "base")
    counts = counts.select(*given.values(), "base", "windows")
    repeats = computed(counts, F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ), "sorted").drop("windows")
    # a start is repeated if its window's neighbour in sorted order is equal
    starts = F.sort_array(F.array_compact(F.transform("sorted", lambda e, j: F.when(
        (e["h"] == F.get("sorted", j + 1)["h"])
        | ((j > 0) & (e["h"] == F.get("sorted", F.greatest(j - 1, F.lit(0)))["h"])), e["i"]))))
    repeats = computed(repeats, starts, "starts").drop("sorted")
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(
            F.lit(3), F.coalesce(F.get("starts", j + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    return repeats.select(
        *[F.col(g).alias(c) for c, g in given.items() if c != "rule"],
        F.struct("base.n_words", "base.word_chars", "base.n_symbols", "base.n_dup_lines",
                 F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
                 "base.chars", "base.common").alias("rule"))


def base_failed() -> Column:
    n = F.col("rule.n_words")
    return (n < MIN_WORDS) | (
        F.col("rule.n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def language_references(features: DataFrame, lang: str = "lang") -> list[dict]:
    """Mean histograms per language, over all documents that pass the base rules.

    Every language with ``MIN_DOCUMENTS`` such documents has one, however large the table, or
    with ``MIN_SHARE`` of them in a small one; what comes to the driver is 46 numbers a language.
    Documents without a language are left out. No such documents: no references.
    """
    good = features.filter(~base_failed() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"),
        F.concat(_share(F.col("rule.chars")), _share(F.col("rule.common"))).alias("bins"))
    bins = CHAR_BINS + len(COMMON_WORDS) + 1
    means = good.groupBy("lang").agg(F.count("*").alias("n"), *[
        F.avg(F.get("bins", F.lit(i))).alias(f"b{i}") for i in range(bins)])
    least = MIN_SHARE * good.limit(round(MIN_DOCUMENTS / MIN_SHARE)).count()
    rows = means.filter(F.col("n") >= least).orderBy("lang").collect()
    return [{"lang": r["lang"], "chars": [r[f"b{i}"] for i in range(CHAR_BINS)],
             "common": [r[f"b{i}"] for i in range(CHAR_BINS, bins)]} for r in rows]


def js_distance(shares: Column, reference: Column | list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram column and another or a fixed one."""
    if isinstance(reference, list):
        reference = F.array(*[F.lit(float(x)) for x in reference])
    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares, reference, lambda p, r: half(p, r) + half(r, p))
    return F.sqrt(F.greatest(
        F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _nearest(name: str, references: list[dict]) -> Column:
    """The distance to the nearest reference; NULL if there is none."""
    if not references:
        return F.lit(None).cast("double")
    known = F.array(*[F.array(*[F.lit(float(x)) for x in r[name]]) for r in references])
    return F.array_min(F.transform(known, lambda r: js_distance(F.col(f"_s.{name}"), r)))


def word_limit(features: DataFrame, references: list[dict]) -> float:
    """The word distance from which a document diverges: the median distance of all documents
    that pass the base rules and are long enough to be judged, and ``WORD_SPREADS`` times what
    lies between it and their ``LOW_SHARE``. Both are read off below the documents that
    diverge, so these do not move the limit as long as they are not many.

    Distances come to the driver as counts of ``DISTANCE_STEPS`` steps.
    """
    long = features.filter(~base_failed() & (F.col("rule.n_words") >= MIN_JUDGED_WORDS))
    rows = computed(long, F.struct(_share(F.col("rule.common")).alias("common")), "_s").select(
        F.floor(_nearest("common", references) * DISTANCE_STEPS).alias("step"))
    counts = rows.filter("step IS NOT NULL").groupBy("step").count().orderBy("step").collect()
    total = sum(r["count"] for r in counts)

    def reached(share: float) -> float:
        seen = 0
        for r in counts:
            seen += r["count"]
            if seen >= share * total:
                return (r["step"] + 0.5) / DISTANCE_STEPS
        return 0.0

    middle = reached(0.5)
    return max(LEAST_WORD_LIMIT, middle + WORD_SPREADS * (middle - reached(LOW_SHARE)))


def judge(features: DataFrame, references: list[dict]) -> DataFrame:
    """Add ``base_failed, kept, char_distance, word_distance`` to rows with ``rule``.

    The distances are those to the nearest language reference, NULL where the document is too
    short to tell (or there are no references); such a document is kept unless a base rule
    fails it. ``features`` are read twice, first for :func:`word_limit`.
    """
    limit = word_limit(features, references)
    chars = F.aggregate("rule.chars", F.lit(0), lambda a, x: a + x)
    rows = computed(features, F.struct(_share(F.col("rule.chars")).alias("chars"),
                                       _share(F.col("rule.common")).alias("common"),
                                       chars.alias("n_chars")), "_s")
    rows = rows.withColumn("char_distance", F.when(
        F.col("_s.n_chars") >= MIN_CHARS, _nearest("chars", references)))
    rows = rows.withColumn("word_distance", F.when(
        F.col("rule.n_words") >= MIN_JUDGED_WORDS, _nearest("common", references)))
    rows = rows.withColumn("base_failed", base_failed())
    diverges = (F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False))
                | F.coalesce(F.col("word_distance") > limit, F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges).drop("_s")


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` with ``rule``, the two distances, ``base_failed`` and ``kept``.

    The features are written once to the shared folder, as the references need them all
    before the first document can be judged.
    """
    features = materialize(rule_features(docs, text), "rules")
    return judge(features, language_references(features, lang))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`apply_rules` keeps, all columns as they are."""
    names = [f"_doc{i}" for i in range(len(docs.columns))]
    found = apply_rules(docs.toDF(*names), names[docs.columns.index(text)],
                        names[docs.columns.index(lang)])
    return found.filter("kept").select(*names).toDF(*docs.columns)
