"""Keyword search of a table of queries, fusion of sources, gating, neighbours and packing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hooks import matches
from ..functions.text import density_multiplier, query_terms
from ..profiles import ScriptProfile
from ..session import Scratch, cut
from .phrases import containing_phrases
from .ranks import ordered, places

#: Caps of the substring match, fixed values of its definition: index words, and postings, of one term.
MOST_KEYS, MOST_POSTINGS = 400, 900


def expand_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """`(query_id, term)`: each term, then its expansions (term, expansion); duplicates stay, they count in the total."""
    more = terms.join(synonyms, "term").select("query_id", F.col("expansion").alias("term"))
    return terms.select("query_id", "term").unionByName(more)


def query_term_table(queries: DataFrame, p: ScriptProfile) -> DataFrame:
    return queries.select("query_id", F.explode(query_terms("query", p)).alias("term"))


def asked_terms(queries: DataFrame, p: ScriptProfile, synonyms: DataFrame | None = None) -> DataFrame:
    terms = query_term_table(queries, p)
    return terms if synonyms is None else expand_terms(terms, synonyms)


#: Letters of the grams by which words are found that contain a term, and grams of a term that are intersected.
GRAM, RAREST = 3, 3


def grams(c: Column | str, size: int = GRAM) -> Column:
    """The distinct stretches of `size` letters of a word, or of its two letters if it has no more."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.least(F.length(c), F.lit(size))
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(c, i, F.lit(size)))
    return F.when(n >= 2, F.array_distinct(F.when(n >= size, cut(size)).otherwise(cut(2))))


def word_grams(words: DataFrame, least_term: int = GRAM) -> DataFrame:
    """`(gram, word)`: every gram of every distinct word; pairs of letters too where terms of two letters are asked for."""
    w = words.select("word").distinct()
    own = w.select(F.explode(grams("word")).alias("gram"), "word")
    if least_term < GRAM:
        own = own.unionByName(w.where(F.length("word") >= GRAM).select(F.explode(grams("word", 2)).alias("gram"), "word"))
    return own


def containing(terms: DataFrame, index: DataFrame) -> DataFrame:
    """`(term, word)`: the words that contain each term (of two letters or more), by an index of their grams.

    A term's rarest grams are looked up, the words that have all of them kept, and these compared. Terms and words meet
    by equality of a gram alone; a term with a gram that no word has is done at once."""
    asked = terms.select("term", F.explode(grams("term")).alias("gram"))
    counts = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("of"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce("of", F.lit(0)), "gram"))
    rare = asked.join(counts, "gram", "left").withColumn("rn", rank).where(F.col("rn") <= RAREST)
    known = rare.groupBy("term").agg(F.count("*").alias("n"), F.count("of").alias("met")).where("n = met").select("term", "n")
    met = rare.select("term", "gram").join(known, "term").join(index.select("gram", "word"), "gram")
    both = met.groupBy("term", "word").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c = n")
    return both.where(F.contains("word", "term")).select("term", "word")


def term_scores(terms: DataFrame, postings: DataFrame, p: ScriptProfile, index: DataFrame | None = None) -> DataFrame:
    """`(term, id, gain)` of distinct terms: index words equal to the term, weight 1 / log2(4 + df); else index words that
    contain it, the MOST_KEYS shortest, of which MOST_POSTINGS postings count, weight 0.85 / log2(4 + sum of df).

    index: the word_grams of the postings' words, built here if it isn't given."""
    asked = terms.select("term").distinct()
    words = postings.where("rnk = 1").select("word", "df")
    exact = asked.join(postings, asked.term == postings.word).select("term", "id", (1 / F.log2(4.0 + F.col("df"))).alias("gain"))
    rest = asked.join(words, asked.term == words.word, "left_anti").where(F.length("term") >= p.least_term)
    near = containing(rest, word_grams(words, p.least_term) if index is None else index).join(words, "word")
    w = Window.partitionBy("term").orderBy(F.length("word"), "word")
    near = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MOST_KEYS)
    near = near.withColumn("total", F.sum("df").over(Window.partitionBy("term"))).withColumn("before", F.sum("df").over(w) - F.col("df"))
    near = near.where(F.col("before") < MOST_POSTINGS)
    gain = (0.85 / F.log2(4.0 + F.least("total", F.lit(2000)))).alias("gain")
    hits = near.select("term", "word", "before", "total").join(postings.select("word", "id", "rnk"), "word")
    hits = hits.where(F.col("before") + F.col("rnk") <= MOST_POSTINGS).select("term", "id", gain)
    return exact.unionByName(hits)


def keyword_scores(queries: DataFrame, postings: DataFrame, chunks: DataFrame, p: ScriptProfile, synonyms: DataFrame | None = None,
                   least_words: int = 8, index: DataFrame | None = None) -> DataFrame:
    """`(query_id, id, book, score)`: summed gains over the number of (expanded) terms, by the chunk's word density.

    Words are counted in the chunks that were found alone. chunks may have those numbers (`real`) ready, as a store has."""
    terms = asked_terms(queries, p, synonyms)
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    total = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    gains = asked.join(term_scores(terms, postings, p, index), "term")
    summed = gains.groupBy("query_id", "id").agg(F.sum(F.col("gain") * F.col("times")).alias("gain")).join(total, "query_id")
    counted = chunks if "real" in chunks.columns else chunks.withColumn("real", matches("text", p.words(3)))
    good = counted.where(F.col("real") >= least_words).select("id", "book", density_multiplier("real").alias("dense"))
    return summed.join(good, "id").select("query_id", "id", "book", F.round(F.col("gain") / F.col("n_terms") * F.col("dense"), 9).alias("score"))


def top_k(scores: DataFrame, k: int = 10, *by: str) -> DataFrame:
    """The k best of each query (and of each further column); ties by id. Spark limits each group before the shuffle."""
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_filters(scores: DataFrame, chunks: DataFrame, **wanted) -> DataFrame:
    """Scores of the chunks whose columns (book, tradition, chapter, ...) equal what is wanted, before any limit.

    None wants nothing. The filter reaches the scan of the chunks; scores keep their columns."""
    asked = {c: v for c, v in wanted.items() if v is not None}
    if not asked:
        return scores
    fits = chunks
    for c, v in asked.items():
        fits = fits.where(F.col(c) == F.lit(v))
    return scores.join(fits.select("id"), "id", "left_semi")


def best_per_book(results: DataFrame, score: str = "rerank", least: float = 0.5) -> DataFrame:
    """`(query_id, book, best, passes)`: the best score of each book, and whether it reaches the gate."""
    best = results.groupBy("query_id", "book").agg(F.max(score).alias("best"))
    return best.withColumn("passes", F.coalesce(F.col("best") >= least, F.lit(False)))


def ordered_reads(chunks: DataFrame, book: str, chapter: int | None = None) -> DataFrame:
    """The chunks of a book, or of one of its chapters, sorted by page and id."""
    own = chunks.where(F.col("book") == F.lit(book))
    return (own if chapter is None else own.where(F.col("chapter") == F.lit(chapter))).orderBy("page", "id")


def point_lookup(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each id (a table of them); nulls where there is none."""
    return ids.select("id").join(chunks, "id", "left")


def priority_union(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """(results, quota) in order of precedence: each cut to its quota by its own scale, the first source owns an id."""
    cut = [top_k(df, quota).withColumn("source", F.lit(i)) for i, (df, quota) in enumerate(sources)]
    every = cut[0]
    for df in cut[1:]:
        every = every.unionByName(df)
    first = Window.partitionBy("query_id", "id").orderBy("source")
    return every.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def max_union(sources: list[DataFrame], n: int = 10) -> DataFrame:
    """The higher score owns an id, the earlier source on ties; n best of each query."""
    every = None
    for i, df in enumerate(sources):
        part = df.select("query_id", "id", "book", "score").withColumn("source", F.lit(i))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("query_id", "id").agg(F.max_by(F.struct("book", "score", "source"), F.struct("score", F.negate("source"))).alias("b"))
    return top_k(best.select("query_id", "id", "b.*"), n)


def diversity_cap(ranked: DataFrame, per_book: int = 3, score: str = "rerank") -> DataFrame:
    w = Window.partitionBy("query_id", "book").orderBy(F.desc(score), "id")
    return ranked.withColumn("in_book", F.row_number().over(w)).where(F.col("in_book") <= per_book)


def diverse_fill(results: DataFrame, n: int = 3) -> DataFrame:
    """The best of each book first, then the rest by score, n a query."""
    w = Window.partitionBy("query_id", "book").orderBy(F.desc("score"), "id")
    first = results.withColumn("later", F.row_number().over(w) > 1)
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("later", F.desc("score"), "id"))).where(F.col("pos") <= n)


def rerank_candidates(candidates: DataFrame, hints: DataFrame, n: int = 100) -> DataFrame:
    """Chunks of the hinted book (query_id, hinted) first, then by score, n a query."""
    hinted = candidates.join(hints, "query_id", "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col("book") == F.col("hinted"), F.lit(False))), F.desc("score"), "id")
    return hinted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def detect_book(queries: DataFrame, hints: DataFrame) -> DataFrame:
    """`(query_id, hinted)`: the hint (hint, book, prio) of lowest prio that the query contains; any number of hints."""
    own = hints.select(F.lower("hint").alias("phrase"), "book", "prio")
    met = containing_phrases(queries.select("query_id", F.lower("query").alias("q")), F.col("q"), own, "phrase").join(own, "phrase")
    return met.groupBy("query_id").agg(F.min_by("book", "prio").alias("hinted"))


def add_neighbours(kept: DataFrame, chunks: DataFrame, top: int = 3, least: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """kept (query_id, id, book, score, rank) with the chunks before and after its first `top` in book order.

    They follow their parent and inherit its score; one already there is not repeated, the first parent claims it.
    chunks: (id, book, page, text); places in a book are found by page and id. Places are those of the whole table; only
    those beside a kept chunk are looked up. Without `scratch` the result is written to the checkpoint folder.
    """
    if scratch is None:
        with Scratch(chunks.sparkSession) as own:
            return cut(add_neighbours(kept, chunks, top, least, own))
    own = chunks.select("book", "page", "id", F.length(F.trim("text")).alias("n"))
    placed = ordered(own, "book", "page", "id", scratch=scratch).drop("page")
    parent = kept.where(F.col("rank") <= top).join(placed.select("id", "row", F.col("book").alias("_b")), "id")
    beside = parent.select("query_id", "book", "score", "rank", "_b", F.posexplode(F.array(F.col("row") - 1, F.col("row") + 1)).alias("_p", "row"))
    near = beside.join(placed.where(F.col("n") > least).select("row", "id", F.col("book").alias("_near")), "row").where("_near = _b")
    near = near.select("query_id", "book", "score", "rank", (F.col("_p") + 1).alias("offset"), "id")
    near = near.join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = Window.partitionBy("query_id", "id").orderBy("rank", "offset")
    near = near.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").withColumn("match_type", F.lit("neighbour"))
    out = kept.select("query_id", "book", "score", "rank", F.lit(0).alias("offset"), "id", F.lit("kept").alias("match_type"))
    return out.unionByName(near.select(*out.columns))


def pack_context(rows: DataFrame, order: list[Column], n: int = 12, long: int = 800, short: int = 300) -> DataFrame:
    """The first n of each query; the first three and neighbours keep `long` characters, others `short`."""
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= n)
    size = F.when((F.col("pos") <= 3) | (F.col("match_type") == "neighbour"), long).otherwise(short)
    return placed.withColumn("text", F.substr("text", F.lit(1), size))


def book_overview(hints: DataFrame, candidates: DataFrame, chunks: DataFrame, least: int = 3, n: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """Evenly spaced chunks (over 60 characters) of a hinted book for queries with fewer than `least` candidates of it.

    Without `scratch` the result is written to the checkpoint folder."""
    if scratch is None:
        with Scratch(chunks.sparkSession) as own:
            return cut(book_overview(hints, candidates, chunks, least, n, own))
    have = candidates.join(hints, "query_id").where("book = hinted").groupBy("query_id").agg(F.count("*").alias("c"))
    short = hints.join(have, "query_id", "left").where(F.coalesce("c", F.lit(0)) < least)
    wanted = short.select(F.col("hinted").alias("book")).distinct()
    books = chunks.where(F.length(F.trim("text")) > 60).select("id", "book", "page").join(wanted, "book", "left_semi")
    spaced = places(books, "book", "page", "id", scratch=scratch)
    spaced = spaced.where(F.pmod("i", F.greatest(F.lit(1), F.floor(F.col("c") / n))) == 0).select("id", "book")
    return short.join(spaced, F.col("hinted") == F.col("book")).select("query_id", "id", "book", F.lit(0.05).alias("score"))
