"""The registered queries of the training-data operators, with production parameters, each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, importance, jaccard_join, language_id, lexical_search, lexical_sql, line_dedup, packing, quality_rules, secrets, secrets_sql,
    substring_dedup, token_counts, toxicity, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "matched_words", "n_tiles", "coverage")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents")).drop("k")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_language(
        _table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"), domain=F.lit("")
    )
    return found.select("doc_id", "language", "probability", "text_language", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), window=1)).drop("k")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.ngram_jaccard_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).drop("tokens")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), least=1).drop("k")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(_table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID with all its evidence: markup, host, registered domain and address suffix of web pages."""
    html = F.col("html")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", language_id.page_text(html).alias("text"))
    found = language_id.identify_language(pages, doc_id="page_id", **language_id.page_evidence(F.col("url"), html))
    return found.select(F.col("doc_id").alias("page_id"), "language", "probability", "text_language", "kept")


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
    "language_id_of_pages": language_id_of_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op4_secret_scan": secrets_sql.sql(),
    "op12_ranked_lexical_search": lexical_sql.SQL,
}
