"""Inverted index, word counts, lexicon and manifests."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.translit import fuzzy_key, romanise
from ..profiles import ScriptProfile
from ..session import Scratch

#: Chunks whose words are counted before they are put out.
STEP = 500


def term_frequencies(chunks: DataFrame, p: ScriptProfile, least: int = 3) -> DataFrame:
    """`(word, id, tf)`: each chunk's words are counted in its own row, over Arrow batches.

    So nothing is shuffled or kept to count them, and no array of all words with their repeats is sorted. Only where ids
    repeat (which is looked up, by the ids alone) are the counts of an id's rows summed."""
    return _counted(chunks, p, least, lambda: Counter)


def _counted(chunks: DataFrame, p: ScriptProfile, least: int, counter: Callable[[], Callable[[list[str]], Counter]]) -> DataFrame:
    """term_frequencies of the words that a function of a text's words counts; each task makes that function once."""
    words, stop = re.compile(p.words(least)), p.stopwords

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = counter()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                found, times, sizes = [], [], []
                for text in batch.column(1).to_pylist():
                    own = counted(words.findall(text)) if text else {}
                    for w in stop:
                        own.pop(w, None)
                    found += own
                    times += own.values()
                    sizes.append(len(own))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), ids, pa.array(times, pa.int64())], ["word", "id", "tf"])

    counts = chunks.select("id", F.lower("text").alias("low")).mapInArrow(count, f"word string, id {dict(chunks.dtypes)['id']}, tf long")
    if chunks.groupBy("id").count().where("count > 1").isEmpty():
        return counts
    return counts.groupBy("word", "id").agg(F.sum("tf").alias("tf"))


def asked_postings(chunks: DataFrame, terms: DataFrame, p: ScriptProfile, scratch: Scratch, top: int = 300, most: int = 500_000) -> DataFrame:
    """Those of build_postings' rows that a search of `terms` (term) needs: of the words that equal a term and, for the
    terms that are no word, of those that contain one. Up to `most` terms go to the scans; for more, all postings are built.

    For a table of queries that is asked once: nothing of other words leaves the scan. Rows are written to `scratch`."""
    asked = terms.select("term").where("term is not null").distinct()
    if asked.count() > most:
        return scratch.staged(build_postings(chunks, p, top))
    spark = chunks.sparkSession
    wanted = frozenset(r["term"] for r in asked.collect())
    shared = spark.sparkContext.broadcast(wanted)

    def equal():
        own = shared.value
        return lambda words: Counter([w for w in words if w in own])

    exact = scratch.staged(rank_postings(_counted(chunks, p, p.least_term, equal), top))
    rest = wanted.difference(r["word"] for r in exact.where("rnk = 1").select("word").collect())
    if not rest:
        return exact
    parts = spark.sparkContext.broadcast(sorted(rest))

    def contain():
        own, automaton = shared.value, ahocorasick.Automaton()
        for term in parts.value:
            automaton.add_word(term, term)
        automaton.make_automaton()

        def counted(words: list[str]) -> Counter:
            # none across words, which are joined by what is in no term
            if next(automaton.iter("\n".join(words)), None) is None:
                return Counter()
            return Counter({w: n for w, n in Counter(words).items() if w not in own and next(automaton.iter(w), None) is not None})

        return counted

    return exact.unionByName(scratch.staged(rank_postings(_counted(chunks, p, p.least_term, contain), top)))


def build_postings(chunks: DataFrame, p: ScriptProfile, top: int = 300) -> DataFrame:
    """`(word, id, tf, rnk, df)`: the `top` chunks of each word by tf, then id; df counts the kept postings."""
    return rank_postings(term_frequencies(chunks, p), top)


def rank_postings(tf: DataFrame, top: int = 300) -> DataFrame:
    """The postings of term counts (word, id, tf), as build_postings gives them."""
    ranked = tf.withColumn("rnk", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("tf"), "id")))
    return ranked.where(F.col("rnk") <= top).withColumn("df", F.count("*").over(Window.partitionBy("word")))


def build_postings_capped(chunks: DataFrame, p: ScriptProfile, most: int = 300) -> DataFrame:
    """`(word, id)` of words in at most `most` chunks; the counts meet the rows by a join, so no word is gathered."""
    pairs = term_frequencies(chunks, p).select("word", "id")
    kept = pairs.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return pairs.join(kept.select("word"), "word")


def assign_shard(word: Column, n: int = 8) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def word_frequency(chunks: DataFrame, p: ScriptProfile) -> DataFrame:
    """`(word, freq)`: words of two letters or more, counted over STEP texts at a time before they are shuffled."""
    words = re.compile(p.words(2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                own = Counter()
                for text in whole.column(0).slice(at, STEP).to_pylist():
                    own.update(words.findall(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    return chunks.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("freq"))


def build_lexicon(freq: DataFrame, *, top: int = 6000, least: int = 4, roman: Column | None = None) -> DataFrame:
    """`(key, native, freq)`: the most frequent word owns a key; the `top` keys by frequency."""
    spelt = freq.where(F.col("freq") >= least).withColumn("roman", romanise("word") if roman is None else roman)
    keyed = spelt.where(F.length("roman") >= 3).withColumn("key", fuzzy_key("roman")).where(F.length("key") >= 2)
    best = keyed.groupBy("key").agg(F.min_by(F.struct("word", "freq"), F.struct(F.negate("freq"), "word")).alias("b"))
    return best.select("key", F.col("b.word").alias("native"), F.col("b.freq").alias("freq")).orderBy(F.desc("freq"), "native").limit(top)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Per book: chunks, words, distinct chapters and (chapter, section) pairs."""
    return chunks.groupBy("book").agg(
        F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.array_sort(F.collect_set("chapter")).alias("chapters"),
        F.count_distinct("chapter").alias("chapter_count"), F.count_distinct("chapter", F.coalesce("section", F.lit(-1))).alias("section_count"),
    )


def book_manifest(chunks: DataFrame) -> DataFrame:
    """Per book: title and language of its first chunk, count, distinct true chapters, page range."""
    first = lambda c: F.min_by(c, F.struct("page", "id")).alias(c)
    return chunks.groupBy("book").agg(
        first("book_title"), first("language"), F.count("*").alias("chunk_count"), F.min("page").alias("page_min"),
        F.max("page").alias("page_max"), F.array_sort(F.collect_set(F.when(F.col("chapter") != 0, F.col("chapter")))).alias("chapters"),
    ).withColumn("chapter_count", F.size("chapters"))


def chapter_manifest(chunks: DataFrame) -> DataFrame:
    """Per (book, chapter): first title and page, ordered chunk ids (a chapter's ids are its value, so they are gathered)."""
    return chunks.where("chapter is not null").groupBy("book", "chapter").agg(
        F.min_by("chapter_title", F.struct("page", "id")).alias("chapter_title"), F.min("page").alias("first_page"), F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("page", "id"))), lambda x: x["id"]).alias("ids"),
    )


def store_meta(chunks: DataFrame, model: str = "hashed", dim: int = 64) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.array_sort(F.collect_set("book")).alias("books"), F.lit(model).alias("embed_model"), F.lit(dim).alias("embed_dim")
    )


def doc_keywords(docs: DataFrame, stop: tuple[str, ...], n: int = 14) -> DataFrame:
    """`(id, word, freq, rnk)`: the n most frequent Latin words of four letters or more, by frequency, then word."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![A-Za-z0-9_])[a-z]{4,}(?![A-Za-z0-9_])"), F.lit(0))).alias("word")
    counts = docs.select("id", word).where(~F.col("word").isin(*stop)).groupBy("id", "word").agg(F.count("*").alias("freq"))
    return counts.withColumn("rnk", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("freq"), "word"))).where(F.col("rnk") <= n)


def doc_stats(docs: DataFrame, *more: str) -> DataFrame:
    """`(id, words, minutes)` of each document, and further columns of it."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    return docs.select("id", words.alias("words"), F.ceil(words / 200).alias("minutes"), *more)


def probe_sources(pages: DataFrame, p: ScriptProfile) -> DataFrame:
    """Per book: median characters a page, share of short words, share of foreign letters, and whether all three pass."""
    words = F.regexp_extract_all("text", F.lit(f"{p.letter}+"), F.lit(0))
    per_page = pages.select(
        "book", F.length("text").alias("n"), F.size(words).alias("w"), F.size(F.filter(words, lambda x: F.length(x) <= 2)).alias("s"),
        F.regexp_count("text", F.lit(r"[^\x00-\x7F]")).alias("o"),
    )
    out = per_page.groupBy("book").agg(
        F.median("n").alias("median_chars"), (F.sum("s") / F.greatest(F.sum("w"), F.lit(1))).alias("fragment_ratio"),
        (100 * F.sum("o") / F.greatest(F.sum("n"), F.lit(1))).alias("foreign_percent"), F.count("*").alias("pages"),
    )
    return out.withColumn("passed", (F.col("median_chars") >= 900) & (F.col("fragment_ratio") <= 0.40) & (F.col("foreign_percent") <= 1.0))
