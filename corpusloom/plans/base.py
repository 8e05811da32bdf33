"""How the given tables stand in for pages, chunks, queries and turns; the same as Spark frames and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hooks import matches
from ..profiles import LATIN


#: A table of fewer bytes a core than this may be one row group, which is one task however many cores there are.
SMALL = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a small one of few files is dealt out to all cores, a large one is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 20 < size < SMALL * cores and len(df.inputFiles()) < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the book, the id is the page, length in thousands the chapter."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("book"), F.concat(F.lit("Title "), "source").alias("book_title"),
        F.col("lang").alias("language"), F.col("doc_id").alias("page"), F.floor(F.length("text") / 1000).cast("int").alias("chapter"),
        F.substring("text", 1, 20).alias("chapter_title"), F.when(F.length("text") % 2 == 0, 1).alias("section"), "text",
        matches("text", r"[^\x09-\x0D\x20]+").alias("word_count"),
    )


CHUNKS = r"""chunks AS (SELECT doc_id AS id, source AS book, 'Title ' || source AS book_title, lang AS language, doc_id AS page,
 CAST(floor(length(text) / 1000) AS INT) AS chapter, substr(text, 1, 20) AS chapter_title, CASE WHEN length(text) % 2 = 0 THEN 1 END AS section,
 text, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS word_count FROM documents)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
STOP = "[" + ", ".join(f"'{w}'" for w in LATIN.stopwords) + "]"
L = LATIN.block

#: Postings and scores of the keyword search over documents, as SQL.
POSTINGS = rf"""tf AS (SELECT w AS word, id, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[{L}]{{3,}}')) AS w FROM chunks)
 WHERE NOT list_contains({STOP}, w) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tf DESC, id) AS rnk FROM tf),
postings AS (SELECT word, id, tf, rnk, count(*) OVER (PARTITION BY word) AS df FROM ranked WHERE rnk <= 300)"""
SCORES = rf"""terms AS (SELECT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[{L}]{{3,}}')) AS term FROM asked)
 WHERE NOT list_contains({STOP}, term)),
wanted AS (SELECT DISTINCT term FROM terms),
words AS (SELECT DISTINCT word, df FROM postings),
exact AS (SELECT term, id, 1 / log2(4.0 + df) AS gain FROM wanted JOIN postings ON term = word),
near AS (SELECT term, word, df, row_number() OVER w AS rn, sum(df) OVER (PARTITION BY term) AS total0 FROM wanted JOIN words ON contains(word, term)
 WHERE term NOT IN (SELECT word FROM words) WINDOW w AS (PARTITION BY term ORDER BY length(word), word)),
near2 AS (SELECT *, sum(df) OVER (PARTITION BY term) AS total, sum(df) OVER (PARTITION BY term ORDER BY length(word), word ROWS UNBOUNDED PRECEDING) - df AS before
 FROM near WHERE rn <= 400),
fuzzy AS (SELECT term, id, 0.85 / log2(4.0 + least(total, 2000)) AS gain FROM near2 JOIN postings USING (word) WHERE before + rnk <= 900),
gains AS (SELECT query_id, id, gain FROM terms JOIN (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) USING (term)),
n_terms AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
good AS (SELECT id, book, len(regexp_extract_all(text, '[{L}]{{3,}}')) AS rw FROM chunks),
scores AS (SELECT query_id, id, book, round(sum(gain) / any_value(n) * any_value(0.5 + 0.5 * least(rw / 40, 1.0)), 9) AS score
 FROM gains JOIN n_terms USING (query_id) JOIN good USING (id) WHERE rw >= 8 GROUP BY query_id, id, book)"""
