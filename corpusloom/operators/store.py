"""The stored index: chunks from pages, tables laid out by the key they are looked up by, and merges of new chunks.

A store is a folder of versions. A version holds term counts (all of them, so that a merge needs no text), postings and
word grams, each bucketed by its key, the chunks' numbers for search, and the manifests. Readers open the newest version
that has its mark; a build or merge writes a whole version, marks it last and so replaces the one before at once. What
fails on the way leaves no mark, and a retry writes again.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk_text
from ..functions.hooks import matches
from ..functions.text import chunk_id, chunkable
from ..profiles import ScriptProfile
from ..session import Scratch
from . import index as I
from .pages import merge_latest, page_structure
from .search import word_grams

#: The tables of a version and the key that they are bucketed by; those without one are looked up by nothing, or small.
BUCKETED = {"terms": "word", "postings": "word", "grams": "gram", "chunks": "id"}
PLAIN = ("chunk_summary", "book_manifest", "chapter_manifest", "meta")
#: What search needs of a chunk beside its text.
SERVED = ("id", "book", "book_title", "language", "page", "chapter", "chapter_title", "section", "word_count", "text")


def build_chunks(
    pages: DataFrame, scratch: Scratch, *, status: Column | None = None, separator: str = r"\n\n+", most: int = 1500, least: int = 80, mode: str = "increment", **patterns
) -> DataFrame:
    """Pages (book, page, text, ...) to chunks: usable pages, their running structure, pieces and ids.

    `id` comes from book, page and the piece's place on the page, so building again gives the same ids. Every chunk of a
    page has the structure after the page's last line. Columns book_title and language pass where pages have them.
    """
    usable = pages.where(chunkable(F.lit("ok") if status is None else status, "text"))
    state = page_structure(usable, scratch=scratch, mode=mode, **patterns)
    kept = [c for c in ("book_title", "language") if c in pages.columns]
    pieces = usable.select("book", "page", *kept, F.posexplode(chunk_text("text", most=most, least=least, separator=separator)).alias("i", "text"))
    rows = pieces.join(state, ["book", "page"], "left")
    return rows.select(
        chunk_id("book", "page", "i").alias("id"), "book", *kept, "page", "i", "chapter", "chapter_title", "section", *(["verse"] if mode != "strict" else []),
        "text", F.regexp_count("text", F.lit(r"\S+")).alias("word_count"),
    )


class Store:
    """A folder of versions; `build` and `merge` write one, the tables of the newest are attributes of `open`."""

    def __init__(self, spark: SparkSession, folder: str, p: ScriptProfile, top: int = 300):
        self.spark, self.folder, self.p, self.top = spark, folder, p, top
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._open: dict[str, DataFrame] = {}
        self._version: int | None = None

    def versions(self) -> list[int]:
        """The finished versions, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(int(f.getPath().getName()[5:]) for f in self._fs.listStatus(self._path(self.folder)) if f.getPath().getName().startswith("done-"))

    def table(self, name: str) -> DataFrame:
        """A table of the newest version, with its buckets."""
        version = self.versions()[-1]
        if version != self._version:
            self.close()
            self._version = version
        if name not in self._open:
            where = f"{self.folder}/v{version}/{name}"
            if name in BUCKETED:
                known, parts = f"store_{uuid.uuid4().hex}", self._buckets(version)
                df = self.spark.read.parquet(where)
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
                self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet OPTIONS (path '{where}') CLUSTERED BY ({BUCKETED[name]}) SORTED BY ({BUCKETED[name]}) INTO {parts} BUCKETS")
                self._open[name] = self.spark.table(known)
                self._open[f"{name}/"] = known
            else:
                self._open[name] = self.spark.read.parquet(where)
        return self._open[name]

    def _buckets(self, version: int) -> int:
        return self.spark.read.parquet(f"{self.folder}/v{version}/buckets").first()[0]

    def close(self) -> None:
        """Forget the tables that are open; the files stay."""
        for name in [x for x in self._open if x.endswith("/")]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._open[name]}")
        self._open.clear()

    def _put(self, version: int, name: str, df: DataFrame, parts: int) -> DataFrame:
        where = f"{self.folder}/v{version}/{name}"
        writer = df.write.option("compression", "zstd").mode("overwrite")
        if name not in BUCKETED:
            writer.parquet(where)
            return self.spark.read.schema(df.schema).parquet(where)
        key, known = BUCKETED[name], f"store_{uuid.uuid4().hex}"
        # a bucket is one file: its rows come together before they are written, which sorts them
        laid = df.repartition(parts, key)
        laid.write.option("compression", "zstd").mode("overwrite").option("path", where).bucketBy(parts, key).sortBy(key).saveAsTable(known)
        self._open[f"{uuid.uuid4().hex}/"] = known
        return self.spark.table(known)

    def _write(self, terms: DataFrame, chunks: DataFrame) -> None:
        def tables(version: int, parts: int) -> None:
            own = self._put(version, "chunks", chunks, parts)
            counts = self._put(version, "terms", terms, parts)
            postings = self._put(version, "postings", I.rank_postings(counts, self.top), parts)
            self._put(version, "grams", word_grams(postings.where("rnk = 1"), self.p.least_term), parts)
            for name, make in MANIFESTS.items():
                self._put(version, name, make(own), parts)

        self._finish(tables)

    def _finish(self, tables: Callable[[int, int], None]) -> None:
        """A version of the tables that a function of its number and its buckets writes."""
        version = (self.versions() or [0])[-1] + 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            tables(version, parts)
            self.spark.range(1).select(F.lit(parts).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/v{version}/buckets")
            self._fs.create(self._path(f"{self.folder}/done-{version}"), True).close()
        except BaseException:
            self._fs.delete(self._path(f"{self.folder}/v{version}"), True)
            raise
        finally:
            self.close()
        for old in self.versions()[:-2]:  # readers of the version before may still be at work
            self._fs.delete(self._path(f"{self.folder}/done-{old}"), False)
            self._fs.delete(self._path(f"{self.folder}/v{old}"), True)

    def build(self, chunks: DataFrame) -> None:
        """A version of these chunks (SERVED) alone."""
        self._write(I.term_frequencies(chunks, self.p), _served(chunks, self.p))

    def build_asked(self, chunks: DataFrame, terms: DataFrame) -> None:
        """A version that serves searches of these terms (term) alone: the postings that they need and the chunks' numbers,
        without texts, term counts and manifests, so nothing can be merged into it."""
        with Scratch(self.spark) as scratch:
            found = I.asked_postings(chunks, terms, self.p, scratch, self.top)

            def tables(version: int, parts: int) -> None:
                postings = self._put(version, "postings", found, parts)
                self._put(version, "grams", word_grams(postings.where("rnk = 1"), self.p.least_term), parts)
                self._put(version, "chunks", _served(chunks, self.p).select("id", "book", "real"), parts)

            self._finish(tables)

    def merge(self, new: DataFrame) -> None:
        """A version in which these chunks take the place of those with their ids, and the others stay.

        Only new chunks are cut into words: of the others the term counts are there. Merging the same chunks again
        changes nothing."""
        ids = new.select("id").distinct()
        terms = self.table("terms").join(ids, "id", "left_anti").unionByName(I.term_frequencies(new, self.p))
        chunks = merge_latest(self.table("chunks"), _served(new, self.p), "id")
        self._write(terms.select("word", "id", "tf"), chunks.select(*SERVED, "real"))


MANIFESTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "chunk_summary": I.chunk_summary, "book_manifest": I.book_manifest, "chapter_manifest": I.chapter_manifest, "meta": I.store_meta,
}


def _served(chunks: DataFrame, p: ScriptProfile) -> DataFrame:
    """The chunks with `real`, their number of real words."""
    return chunks.select(*SERVED, matches("text", p.words(3)).alias("real"))
