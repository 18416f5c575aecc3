"""Building a stored corpus from source files, and asking it questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan import schemas
from versespan.operators import (
    cells, commentaries, constraints, dictionary, errata, export, intervals, lookup, references,
    search, selection, sheets, stories,
)
from versespan.operators.joins import Checked
from versespan.session import materialize
from versespan.sources import files, sinks
from versespan.streaming import sheets as sheet_log

_RENDERED = ("source string, book string, title string, address string, a bigint, b bigint, "
             "language string, book_number int, start_chapter bigint, start_verse bigint, "
             "chapter bigint")
_STORY_INDEX = ("source string, book string, title string, address string, a bigint, b bigint, "
                "block bigint, lo bigint, hi bigint")
_COMMENTARY_INDEX = ("language string, source_number int, book_number int, marker string, "
                     "text string, chapter_from int, verse_from int, block bigint, lo bigint, "
                     "hi bigint")
_CHAPTERS = ("language string, source string, book string, book_number int, chapter int, "
             "n bigint")


def _raw_tables(spark: SparkSession, root: str, fmt: str) -> dict[str, DataFrame]:
    found = {}
    for table in ("info", *schemas.TABLES):
        if table == "sources":
            continue
        try:
            found[table] = files.read_sources(spark, root, table, fmt)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
    return found


def build_corpus(spark: SparkSession, root: str, out: str, fmt: str = "parquet",
                 refs: str | None = None, book_names: DataFrame | None = None) -> None:
    """Merge the source files below ``root`` and store the corpus at ``out``.

    Texts and markers are corrected before anything reads them. Rows a table does not
    accept go to ``rejects/<table>``. Derived and stored with the rest are the chapters that
    exist, the rendered stories, interval indexes of stories and commentaries, and the fields of
    the dictionary's entries. ``refs`` is the path of a reference list whose book names
    ``book_names`` (``name, number``) explains; references lie in order of their place.
    """
    merged = files.merge_corpus(_raw_tables(spark, root, fmt))
    if "verses" in merged:
        merged["verses"] = errata.apply_errata(merged["verses"])
    if "commentaries" in merged:
        merged["commentaries"] = errata.repair_markers(merged["commentaries"])
    accepted = {}
    for table, df in merged.items():
        kept, rejects = constraints.check_constraints(
            df, schemas.NOT_NULL[table], schemas.ROW_KEY.get(table))
        accepted[table] = kept
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/{table}")
    sinks.load_tables(accepted, out)
    if refs is not None and book_names is not None:
        numbered = references.normalize_cross_refs(files.read_cross_refs(spark, refs), book_names)
        place = ["book_number", "chapter", "verse"]
        errata.add_missing_reference(numbered).repartitionByRange(*place) \
            .sortWithinPartitions(*place).write.mode("overwrite").parquet(f"{out}/refs")

    stored = Corpus(spark, out)
    lookup.stored_directory(stored.verses).write.mode("overwrite").parquet(f"{out}/chapters")
    stories.render_stories(stored.stories, stored.books, stored.sources).write.mode(
        "overwrite").parquet(f"{out}/rendered")
    intervals.store_index(stories.story_index(stored.rendered), ["source", "book"], "source",
                          f"{out}/story_index")
    intervals.store_index(commentaries.commentary_index(stored.commentaries),
                          ["language", "source_number", "book_number"], "language",
                          f"{out}/commentary_index")
    dictionary.read_entries(stored.dictionary).repartitionByRange("topic").write.mode(
        "overwrite").parquet(f"{out}/entries")


@dataclass(frozen=True)
class Corpus:
    """A stored corpus. Each method answers a table of requests."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return self.spark.createDataFrame([], schema)

    def _canonical(self, name: str) -> DataFrame:
        schema = schemas.TABLES[name]
        return self._table(name, schema).select(*schema.names)

    @property
    def sources(self) -> DataFrame:
        return self._canonical("sources")

    @property
    def books(self) -> DataFrame:
        return self._canonical("books")

    @property
    def verses(self) -> DataFrame:
        return self._canonical("verses")

    @property
    def stories(self) -> DataFrame:
        return self._canonical("stories")

    @property
    def commentaries(self) -> DataFrame:
        return self._canonical("commentaries")

    @property
    def dictionary(self) -> DataFrame:
        return self._canonical("dictionary")

    @property
    def refs(self) -> DataFrame:
        return self._table("refs", schemas.REFS)

    @property
    def chapters(self) -> DataFrame:
        return self._table("chapters", _CHAPTERS)

    @property
    def rendered(self) -> DataFrame:
        return self._table("rendered", _RENDERED)

    @property
    def story_index(self) -> DataFrame:
        return self._table("story_index", _STORY_INDEX)

    @property
    def commentary_index(self) -> DataFrame:
        return self._table("commentary_index", _COMMENTARY_INDEX)

    @property
    def entries(self) -> DataFrame:
        return self._table("entries", dictionary.ENTRIES)

    @property
    def sheets(self) -> DataFrame:
        """User sheets as they are after the last change stored."""
        return sheet_log.current_sheets(self.spark, f"{self.path}/sheets")

    @property
    def embeddings(self) -> DataFrame:
        return self._table("embeddings", "id string, source string, embedding array<float>")

    def fetch_verses(self, requests: DataFrame) -> Checked:
        return lookup.fetch_verses(requests, self.verses, self.books, self.chapters)

    def verse_metadata(self, requests: DataFrame) -> DataFrame:
        return lookup.verse_metadata(requests, self.verses, keyed=True)

    def fetch_commentaries(self, requests: DataFrame) -> Checked:
        return commentaries.fetch_commentaries(requests, self.commentary_index)

    def fetch_stories(self, requests: DataFrame) -> Checked:
        return stories.fetch_stories(requests, self.story_index)

    def cross_references(self, requests: DataFrame) -> Checked:
        return references.cross_references(requests, self.refs, self.books)

    def cross_references_by_address(self, requests: DataFrame) -> Checked:
        return references.cross_references_by_address(
            requests, self.refs, self.books, self.sources)

    def verse_dictionary(self, requests: DataFrame) -> Checked:
        return dictionary.verse_dictionary(requests, self.verses, self.entries,
                                           keyed=True)

    def index_vectors(self) -> None:
        """Deal the stored vectors of existing verses to cells, for ``nearest``."""
        cells.store_cells(self.verses.select("id", "source").join(
            self.embeddings.select("id", "embedding"), "id"), f"{self.path}/cells")

    def nearest(self, queries: DataFrame, k: int = search.RESULTS) -> DataFrame:
        """The ``k`` verses of its source nearest to each ``(request_id, source, vector)``, as
        ``index_vectors`` last saw them."""
        return cells.nearest_in_cells(
            queries, cells.read_cells(self.spark, f"{self.path}/cells"), k).rows

    def browse(self, requests: DataFrame, k: int = search.RESULTS) -> Checked:
        """The first ``k`` verses of each address."""
        return search.browse(requests, self.verses, self.books, k, self.chapters)

    def search(self, requests: DataFrame, embed: search.Embed, k: int = search.RESULTS) -> Checked:
        return search.search_verses(requests, self.verses, self.books, self.embeddings, embed,
                                    k, chapters=self.chapters)

    def select(self, selected: DataFrame) -> selection.Bundle:
        return selection.selection_bundle(
            selected, verses=self.verses, books=self.books, sources=self.sources,
            refs=self.refs, rendered=self.story_index, commentaries=self.commentary_index,
            dictionary=self.entries, keyed=True)

    def export(self, requests: DataFrame) -> DataFrame:
        """JSON documents as ordered parts ``request_id, part, text``."""
        return export.export_documents(export.export_rows(
            requests, self.verses, self.chapters).rows)

    def upsert_sheets(self, changes: DataFrame, batch_id: int) -> DataFrame:
        """Store a batch of ``id, data, ts`` changes and return those without data, which are
        rejected. Batches count up; storing one again replaces it."""
        sheet_log.write_changes(changes, f"{self.path}/sheets", batch_id)
        return sheets.check_changes(changes).rejects

    def fetch_sheets(self, ids: DataFrame) -> DataFrame:
        return sheets.fetch_sheets(self.sheets, ids)

    def hydrate_sheets(self, ids: DataFrame) -> DataFrame:
        return sheets.hydrate_sheets(self.fetch_sheets(ids), self.verses, self.books,
                                     self.chapters)

    def cleanup_sheets(self, as_of: Column) -> sheets.Cleanup:
        """Store the sheet table anew without stale sheets: what is kept, and how many went."""
        removed = materialize(sheets.cleanup_sheets(self.sheets, as_of).removed, "removed")
        sheet_log.fold(self.spark, f"{self.path}/sheets", as_of)
        return sheets.Cleanup(self.sheets, removed)

    def fold_sheets(self) -> None:
        """Put the changes so far into a snapshot, so that later reads open fewer folders."""
        sheet_log.fold(self.spark, f"{self.path}/sheets")

    def expand_batch(self, inputs: DataFrame) -> DataFrame:
        return sheets.expand_batch(inputs)

    def sheet_markdown(self, ids: DataFrame) -> DataFrame:
        """Markdown as ordered parts ``sheet_id, title, part, text``."""
        return export.sheet_markdown(self.fetch_sheets(ids), self.verses, self.books,
                                     self.chapters)

    def list_sources(self, query: str = "") -> DataFrame:
        return lookup.list_sources(self.sources, F.lit(query))

    def embed_source(self, source: str, embed: search.Embed) -> DataFrame:
        """Embed what a source still lacks, store it, and return the texts that failed."""
        new = materialize(search.embed_backlog(
            self.verses, self.embeddings, embed, source), "embedded")
        new.filter(F.col("error").isNull()).select("id", "source", "embedding").write.mode(
            "append").partitionBy("source").parquet(f"{self.path}/embeddings")
        return new.filter(F.col("error").isNotNull()).select("id", "error")
