"""Text quality, cleaning, chunking and query normalisation over documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import ocr as O
from ..functions import text as T
from ..functions import translit as R
from ..functions.hooks import nfc
from ..operators import index as I
from ..operators import pages as P
from ..operators import usage as U
from ..operators import verify as V
from ..operators.store import build_chunks
from ..profiles import DEVANAGARI, LATIN
from ..operators.ranks import places
from ..session import Scratch, cut
from .base import ASKED, CHUNKS, L, asked, chunks, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@query("p01_script_ratio", rf"""WITH {CHUNKS} SELECT id, round(len(regexp_extract_all(text, '[{L}]')) / greatest(length(text), 1), 9) AS by_chars,
 round(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) / greatest(len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]')), 1), 9) AS by_letters FROM chunks""")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.round(T.script_ratio("text", LATIN), 9).alias("by_chars"), F.round(T.script_ratio("text", LATIN, "letters"), 9).alias("by_letters"))


@query("p02_confidence")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", T.confidence("text", "language", LATIN).alias("confidence"))


@query("p03_page_status", rf"""WITH {CHUNKS} SELECT id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 THEN 'blank'
 WHEN len(regexp_extract_all(text, '[{L}]')) / length(text) < 0.75 THEN 'low_conf' ELSE 'ok' END AS status FROM chunks""")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", T.page_status("text", T.script_ratio("text", LATIN), F.lit(False), 0.75).alias("status"))


@query("p04_chunkable", rf"""WITH {CHUNKS} SELECT book, count(*) AS n FROM chunks WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30 GROUP BY book""")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    status = T.page_status("text", F.lit(1.0), F.lit(False))
    return chunks(spark, sf).where(T.chunkable(status, "text")).groupBy("book").agg(F.count("*").alias("n"))


@query("p05_real_word_gate", rf"""WITH {CHUNKS}, c AS (SELECT id, len(regexp_extract_all(text, '[{L}]{{3,}}')) AS n FROM chunks)
 SELECT id, CAST(n AS INT) AS n_words, round(0.5 + 0.5 * least(n / 40, 1.0), 9) AS multiplier FROM c WHERE n >= 8""")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    d = chunks(spark, sf).where(T.real_words("text", LATIN) >= 8)
    return d.select("id", T.real_words("text", LATIN).alias("n_words"), F.round(T.density_multiplier("text", LATIN), 9).alias("multiplier"))


@query("p06_text_flags", rf"""WITH {CHUNKS}, c AS (SELECT *, regexp_extract_all(text, '[{L}]+') AS w, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS dv FROM chunks)
 SELECT id, regexp_matches(text, '[.!?](?:\s|$)') AS has_sentences,
 len(w) >= 12 AND len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1) > 0.4 AS garbled,
 dv > 20 AND len(regexp_extract_all(text, '[Ā-ʯ]')) > 0.15 * dv AS legacy,
 CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9]{{0,12}}$'))) AS INT) AS bad_tokens,
 len(regexp_extract_all(text, '[{L}]')) / length(text) < 0.4 AS wrong_script FROM c""")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select(
        "id", T.has_sentences("text", LATIN).alias("has_sentences"), T.looks_garbled("text", LATIN).alias("garbled"), T.legacy_encoded("text").alias("legacy"),
        T.bad_token_count("text").alias("bad_tokens"), T.is_wrong_script("text", LATIN).alias("wrong_script"))


@query("p11_scanned_documents", rf"""WITH {CHUNKS}, c AS (SELECT book, page, len(regexp_extract_all(text, '\p{{L}}{{3,}}')) AS n FROM chunks),
 b AS (SELECT book, sum(n) AS words, sum(CASE WHEN page <= 10 THEN n ELSE 0 END) AS early, count(*) AS pages FROM c GROUP BY book)
 SELECT book, CAST(words AS BIGINT) AS words, words < 30 OR (pages > 15 AND early < 20) AS scanned FROM b""")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return P.scanned_documents(chunks(spark, sf))


TOPICS = (("licence", "licensed under", 1), ("contact", "@", 2), ("secret", "password", 3), ("insult", "idiot", 4), ("insult", "trash", 4), ("table", " | ", 5))


@query("p12_topic_flags", f"""WITH {CHUNKS}, r(topic, pattern, prio) AS (VALUES {", ".join(map(str, TOPICS))})
 SELECT id, arg_min(topic, prio) AS topic FROM chunks JOIN r ON contains(lower(text), pattern) GROUP BY id""")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return V.topic_flags(chunks(spark, sf), spark.createDataFrame(TOPICS, "topic string, pattern string, prio int"))


@query("p13_answer_flags", f"""SELECT conv_id, turn, coalesce(regexp_matches(text, '(?i){T.DISCLAIMER.replace("'", "''")}'), false) AS disclaims,
 coalesce(regexp_matches(text, '(?i){T.HEALTH}'), false) AS health FROM conversations""")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.disclaims("text").alias("disclaims"), T.is_health_query("text").alias("health"))


@query("p14_rights_gate", f"""WITH {CHUNKS}, r AS (SELECT DISTINCT source AS book, 'publisher of ' || source AS publisher, CASE WHEN source < 'src15' THEN 'open' ELSE 'closed' END AS access
 FROM documents WHERE source < 'src5') SELECT book, coalesce(access = 'open', false) AS open, publisher, count(*) AS n FROM chunks LEFT JOIN r USING (book) GROUP BY ALL""")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    rights = chunks(spark, sf).where("book < 'src5'").select("book", F.when(F.col("book") < "src15", "open").otherwise("closed").alias("access"), F.concat(F.lit("publisher of "), "book").alias("publisher")).distinct()
    return U.readable(chunks(spark, sf), rights).groupBy("book", "open", "publisher").agg(F.count("*").alias("n"))


@query("f01_clean_page")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "pages").select("page_id", nfc("html").alias("html"))
    clean = d.select("page_id", T.clean_page("html", DEVANAGARI).alias("t"))
    return clean.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("f02_clean_ocr_tokens")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.length(O.clean_ocr_tokens("text")).alias("n"), F.length(O.clean_display("text")).alias("n_display"))


@query("f04_clean_extracted", rf"""WITH {CHUNKS} SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'),
 '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM chunks""")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.md5(T.clean_extracted("text")).alias("digest"))


def _pack_sql(name: str, pieces: str, glue: str, most: int, least: int) -> str:
    """Recursive greedy packing of pieces(id, part, l) to rows name(id, part, n, x)."""
    return rf"""{name}_r(id, part, l, i, cur, n, o) AS (SELECT id, part, l, 0, '', 0, CAST(NULL AS VARCHAR) FROM {pieces}
 UNION ALL SELECT id, part, l, i + 1,
  CASE WHEN i >= len(l) THEN '' WHEN cur = '' THEN l[i + 1] WHEN length(cur || {glue} || l[i + 1]) > {most} THEN l[i + 1] ELSE cur || {glue} || l[i + 1] END, i,
  CASE WHEN cur <> '' AND (i >= len(l) OR length(cur || {glue} || l[i + 1]) > {most}) THEN regexp_replace(cur, '^\s+|\s+$', '', 'g') END
 FROM {name}_r WHERE i <= len(l)),
{name} AS (SELECT id, part, n, o AS x FROM {name}_r WHERE length(o) >= {least})"""


CHUNKED = rf"""{CHUNKS},
p0 AS (SELECT id, 0 AS part, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM chunks),
{_pack_sql('first', 'p0', 'chr(10) || chr(10)', 1500, 80)},
p1 AS (SELECT id, n AS part, string_split(regexp_replace(x, '([।.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM first WHERE length(x) > 1500),
{_pack_sql('again', 'p1', "' '", 1500, 80)},
cut AS (SELECT id, n AS a, 0 AS b, x FROM first WHERE length(x) <= 1500 UNION ALL SELECT id, part, n, x FROM again),
made AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a, b) - 1 AS INT) AS i, x FROM cut)"""


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    """`id, book, page, i, text, chunk_id`: documents cut into chunks."""
    d = chunks(spark, sf).select("id", "book", "page", F.posexplode(C.chunk_text("text", separator="\n")).alias("i", "text"))
    return d.withColumn("chunk_id", T.chunk_id("book", "page", "i"))


@query("f05_chunk_pages", rf"""WITH RECURSIVE {CHUNKED}
 SELECT id, i, CAST(length(x) AS INT) AS n, md5(x) AS digest,
 'ck_' || substr(sha256(book || '::' || printf('%04d', id) || '::' || printf('%04d', i)), 1, 12) AS chunk_id FROM made JOIN chunks USING (id)
""")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(spark, sf).select("id", "i", F.length("text").alias("n"), F.md5("text").alias("digest"), "chunk_id")




@query("w07_chunk_positions", rf"""WITH RECURSIVE {CHUNKED}
 SELECT id, i, CAST(i + 1 AS INT) AS paragraph, CAST(row_number() OVER (PARTITION BY book ORDER BY page, i) - 1 AS INT) AS in_book FROM made JOIN chunks USING (id)""")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        placed = places(chunked(spark, sf).select("id", "book", "page", "i"), "book", "page", F.col("i"), scratch=scratch, place="in_book")
        return cut(placed.select("id", "i", (F.col("i") + 1).alias("paragraph"), F.col("in_book").cast("int").alias("in_book")))


@query("q02_build_chunks", rf"""WITH RECURSIVE {CHUNKED.replace("FROM documents)", r"FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30)")},
 l AS (SELECT book, page, i, string_split(text, chr(10))[i] AS t FROM (SELECT book, page, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM chunks)),
 k AS (SELECT *, CASE WHEN regexp_matches(t, '^T\D*\d') THEN TRY_CAST(regexp_extract(t, '^T\D*(\d+)', 1) AS INT) END AS num FROM l),
 state AS (SELECT book, page, arg_max(ch, i) AS chapter FROM (SELECT book, page, i, coalesce(last_value(num IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, i), -1) AS ch FROM k) GROUP BY ALL)
 SELECT 'ck_' || substr(sha256(c.book || '::' || printf('%04d', id) || '::' || printf('%04d', i)), 1, 12) AS id, c.book, c.page, i, s.chapter, md5(x) AS digest,
 CAST(len(regexp_extract_all(x, '\S+')) AS INT) AS word_count FROM made JOIN chunks c USING (id) JOIN state s ON s.book = c.book AND s.page = c.page""")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    pages = chunks(spark, sf).select("book", "page", "text")
    with Scratch(spark) as scratch:
        built = build_chunks(
            pages, scratch, status=T.page_status("text", F.lit(1.0), F.lit(False)), separator="\n", mode="strict",
            chapter=(r"^T\D*(\d+)",), section=(r"^\x00$",), verse=(r"^\x00$",),
        )
        return cut(built.select("id", "book", "page", "i", F.coalesce("chapter", F.lit(-1)).alias("chapter"), F.md5("text").alias("digest"), "word_count"))


@query("f06_chunk_overlap")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    d = chunks(spark, sf).select("id", F.posexplode(C.chunk_overlap("text", separator="\n")).alias("i", "t"))
    return d.select("id", "i", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("f07_pack_paragraphs")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.size(C.pack_paragraphs("text", separator="\n")).alias("packs"))


@query("f09_detect_sections")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    heading = r"^(\p{L}+) \| (\p{L}+)"
    found = P.detect_sections(chunks(spark, sf).select("id", "text"), heading=heading)
    return found.select("id", "section", "title", F.md5("content").alias("digest"))


@query("f11_query_terms", rf"""WITH {ASKED} SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(query), '[{L}]{{3,}}'), lambda x: NOT list_contains({"[" + ", ".join(f"'{w}'" for w in LATIN.stopwords) + "]"}, x)), ' ') AS terms FROM asked""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("query_id", F.array_join(T.query_terms("query", LATIN), " ").alias("terms"))


@query("f13_fuzzy_keys")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    freq = I.word_frequency(chunks(spark, sf), LATIN)
    return freq.select("word", "freq", R.fuzzy_key("word").alias("key"))


@query("f15_query_language", r"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) / greatest(len(regexp_extract_all(text, '[\p{L}\p{M}]')), 1) >= 0.3 THEN 'hi'
 WHEN len(regexp_extract_all(lower(text), '[a-z]{2,}')) = 0 THEN 'unknown' WHEN list_has_any(regexp_extract_all(lower(text), '[a-z]{2,}'), [""" + ", ".join(f"'{w}'" for w in T.GRAMMAR) + """]) THEN 'mixed' ELSE 'en' END AS language FROM conversations""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.query_language("text", DEVANAGARI).alias("language"))


@query("f16_normalise_query")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        freq = scratch.staged(I.word_frequency(chunks(spark, sf), LATIN))
        lexicon = cut(I.build_lexicon(freq, roman=F.lower("word")).select("key", "native"))
        words = cut(freq.where("freq > 500").select(F.lower("word").alias("word")).distinct().withColumn("native", F.upper("word")))
    return R.transliterate(table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")).select("id", "text"), "text", words, lexicon).select("id", F.md5("query").alias("digest"), "transliterated")


@query("f17_homoglyph_repair")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    text, fixed = R.repair_homoglyphs(F.translate("text", "ao", "ао"))
    return chunks(spark, sf).select("id", F.md5(text).alias("digest"), fixed.alias("fixed"))


@query("f18_strip_self_citation")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.strip_self_citation("text")).alias("digest"))


@query("f19_norm_evidence", rf"""WITH {CHUNKS} SELECT id, md5(lower(regexp_replace(text, '[^ऀ-ॿA-Za-z0-9]', '', 'g'))) AS digest FROM chunks""")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.md5(T.norm_evidence("text")).alias("digest"))


@query("f23_document_profile", rf"""WITH {CHUNKS} SELECT id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS words, CAST(ceil(len(regexp_extract_all(text, '\S+')) / 200) AS BIGINT) AS minutes,
 md5('=== DOCUMENT ' || id || ' ===' || chr(10) || 'Words: ~' || len(regexp_extract_all(text, '\S+')) || chr(10) || substr(text, 1, 28000)) AS context FROM chunks""")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    stats = I.doc_stats(chunks(spark, sf), "text")
    context = F.concat(F.lit("=== DOCUMENT "), F.col("id").cast("string"), F.lit(" ===\nWords: ~"), F.col("words").cast("string"), F.lit("\n"), F.substring("text", 1, 28000))
    return stats.select("id", "words", "minutes", F.md5(context).alias("context"))


@query("f24_budget_windows", rf"""WITH {CHUNKS}, w AS (SELECT id, text, 10200 AS b, 1133 AS s, floor((length(text) - 1133) / 8) AS st FROM chunks)
 SELECT id, md5(CASE WHEN length(text) <= b THEN text ELSE array_to_string(list_transform(range(0, 9), lambda i: substr(text, CAST(i * st + 1 AS INT), s)), '|') END) AS digest FROM w""")
def f24(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.md5(F.array_join(T.budget_windows("text", LATIN), "|")).alias("digest"))


@query("f25_highlight")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    d = chunks(spark, sf)
    return d.select("id", T.highlight("text", F.substring("text", 1, 30)).alias("preview"))


@query("f26_reply_language")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.reply_language("text", F.lit("en"), DEVANAGARI).alias("language"))


@query("f27_extract_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS has FROM events")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\nreply: "), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", T.extract_json(fenced, "k string")["k"].alias("k"), F.col("props").isNotNull().alias("has"))


@query("f28_plain_text", rf"""WITH {CHUNKS} SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(book_title || ' ' || text, '[*_#>`~|]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM chunks""")
def f28(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("id", F.md5(T.plain_text("book_title", "text")).alias("digest"))


@query("f29_day_slot", """SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN hour(ts + INTERVAL 330 MINUTE) < 11 THEN 'morning'
 WHEN hour(ts + INTERVAL 330 MINUTE) < 16 THEN 'afternoon' ELSE 'evening' END AS slot FROM events""")
def f29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.local_day("ts").alias("day"), T.day_slot("ts").alias("slot"))


@query("f30_subject_phrase")
def f30(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("query_id", T.subject_phrase("query").alias("subject"))
