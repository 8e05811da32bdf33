"""JSON pages and chunks in, Parquet stores and index shards out. Paths are read by Spark alone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import assign_shard

PAGE = """meta struct<book_id:string,book_title:string,tradition:string,source_pdf:string,source_page:int,page_display:int,language:string,script:string>,
 qa struct<method:string,ocr_lang:string,status:string,confidence:double,is_duplicate:boolean,char_count:int,word_count:int,devanagari_pct:double>,
 book_id string, page int, text string, confidence double, ocr_lang string, pipeline string"""
CHUNK = """book string, chunks array<struct<id:string,book:string,book_title:string,tradition:string,page:int,chapter:int,chapter_title:string,section:int,
 verse:int,language:string,text:string,word_count:int,confidence:double>>"""
SERVING = ("id", "book", "book_title", "tradition", "page", "chapter", "chapter_title", "section", "verse", "language", "text", "word_count", "confidence")


def read_pages(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """Page files of both forms as one table; page 0 and null fall back to the number in the file's name, then to 0."""
    raw = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_name"))
    named = F.regexp_extract("_file", r"(\d+)\.json$", 1).try_cast("int")
    out = raw.select(
        F.coalesce("meta.book_id", "book_id").alias("book_id"), F.col("meta.book_title").alias("book_title"), F.col("meta.language").alias("language"),
        F.coalesce(F.nullif("meta.source_page", F.lit(0)), "page", named, F.lit(0)).alias("page"), F.col("qa.status").alias("status"),
        F.coalesce("qa.confidence", "confidence").alias("confidence"), "text", F.col("meta.page_display").alias("_d"),
    )
    out = out.withColumn("page_display", F.coalesce("_d", F.col("page") + 1)).drop("_d")
    return out if registry is None else out.join(registry, "book_id", "left")


def read_chunks(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """Per-book chunk files, exploded; files that don't parse and chunks of under `least` characters are left out."""
    raw = spark.read.schema(CHUNK + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = raw.where("chunks is not null").select(F.explode("chunks").alias("c")).select("c.*")
    return rows.where(F.length(F.trim("text")) >= least)


def write_store(chunks: DataFrame, path: str) -> None:
    """The serving columns, one folder a book; books of any size are spread over files by their id."""
    chunks.select(*SERVING).repartition("book", F.pmod(F.xxhash64("id"), F.lit(64))).write.partitionBy("book").mode("overwrite").parquet(path)


def write_index_shards(postings: DataFrame, path: str, n: int = 8) -> None:
    postings.withColumn("shard", assign_shard(F.col("word"), n)).write.partitionBy("shard").mode("overwrite").parquet(path)
