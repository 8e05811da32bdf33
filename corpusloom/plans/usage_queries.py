"""Pages, usage policy, conversation turns, grounding and the almanac."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import almanac as A
from ..operators import pages as P
from ..operators import usage as U
from ..operators import verify as V
from ..profiles import LATIN
from ..session import Scratch, cut
from ..streaming import ingest, policy
from .base import CHUNKS, L, chunks, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


GRAMS = r"""gr AS (SELECT book, page, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [] END AS t
 FROM (SELECT book, page, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM chunks))"""


@query("u03_trigram_jaccard", rf"""WITH {CHUNKS}, {GRAMS}, p AS (SELECT book, page, t, lag(t) OVER (PARTITION BY book ORDER BY page) AS b FROM gr)
 SELECT book, page, round(CASE WHEN len(t) > 0 AND len(b) > 0 THEN len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b))) ELSE 0 END, 9) AS similarity FROM p WHERE b IS NOT NULL""")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        d = P.like_previous(chunks(spark, sf), scratch).where("similarity is not null")
        return cut(d.select("book", "page", F.round("similarity", 9).alias("similarity")))


@query("w05_duplicate_of_previous", rf"""WITH {CHUNKS}, {GRAMS}, p AS (SELECT book, page, t, lag(t) OVER (PARTITION BY book ORDER BY page) AS b FROM gr)
 SELECT book, page, coalesce(len(t) > 0 AND len(b) > 0 AND len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b))) > 0.85, false) AS duplicate FROM p""")
def w05a(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_duplicate_pages(chunks(spark, sf).withColumn("usable", F.lit(True)), mode="previous", keep=("book", "page"))


@query("w05_duplicate_pages")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    pages = chunks(spark, sf).withColumn("usable", F.length("text") >= 30)
    return P.flag_duplicate_pages(pages).select("book", "page", "duplicate")


@query("q01_ingest_pages")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    pages = chunks(spark, sf).withColumn("confidence", T.confidence("text", "language", LATIN))
    pages = pages.withColumn("usable", (F.length(F.trim("text")) >= 30) & (F.col("confidence") >= 0.15))
    flagged = P.flag_duplicate_pages(pages)
    return P.extraction_summary(flagged.withColumn("status", T.page_status("text", "confidence", "duplicate")))


@query("a01_extraction_summary", rf"""WITH {CHUNKS}, s AS (SELECT *, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 THEN 'blank' WHEN c < 0.75 THEN 'low_conf' WHEN language = 'es' THEN 'duplicate' ELSE 'ok' END AS status
 FROM (SELECT *, len(regexp_extract_all(text, '[{L}]')) / length(text) AS c FROM chunks))
 SELECT book, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status IN ('blank', 'low_conf')) AS failed, count(*) FILTER (WHERE status = 'duplicate') AS skipped,
 CAST(coalesce(sum(length(text)) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS chars, round(coalesce(avg(c) FILTER (WHERE status = 'ok'), 0), 6) AS avg_confidence FROM s GROUP BY ROLLUP (book)""")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    pages = chunks(spark, sf).withColumn("confidence", T.script_ratio("text", LATIN))
    return P.extraction_summary(pages.withColumn("status", T.page_status("text", "confidence", F.col("language") == "es", 0.75)))


@query("w06_structure")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    found = P.page_structure(chunks(spark, sf).select("book", "page", "text"), chapter=(r"(?i)^the\b\D*(\d*)",), section=(r"(?i)^of\b\D*(\d*)",), verse=(r"\.$",))
    return found.select("book", "page", "chapter", "section", "verse", F.md5("chapter_title").alias("title"))


@query("w06_structure_strict", rf"""WITH {CHUNKS}, l AS (SELECT book, page, i, string_split(text, chr(10))[i] AS t FROM (SELECT book, page, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM chunks)),
 k AS (SELECT *, CASE WHEN regexp_matches(t, '^T\D*\d') THEN TRY_CAST(regexp_extract(t, '^T\D*(\d+)', 1) AS INT) END AS num FROM l)
 SELECT book, page, arg_max(ch, i) AS chapter FROM (SELECT book, page, i, coalesce(last_value(num IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, i), -1) AS ch FROM k) GROUP BY ALL""")
def w06b(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.classify_lines(chunks(spark, sf), chapter=(r"^T\D*(\d+)",), section=(r"^\x00$",), verse=(r"^\x00$",))
    state = P.running_structure(lines, "strict").withColumn("chapter", F.coalesce("chapter", F.lit(-1)))
    return state.groupBy("book", "page").agg(F.max_by("chapter", "line").alias("chapter"))


@query("w08_page_parts", f"""WITH {CHUNKS}, f AS (SELECT book, min(page) AS first FROM chunks GROUP BY book)
 SELECT book, CAST(floor((page - first) / 50) AS INT) AS part, min(page) AS page_from, max(page) AS page_to, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks JOIN f USING (book) GROUP BY ALL""")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_parts(chunks(spark, sf))


@query("s06_resume_scan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    return P.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("s07_merge_latest", "SELECT d.doc_id, coalesce(l.quality, 2) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", F.lit(2).cast(dict(table(spark, sf, "labels").dtypes)["quality"]).alias("quality"))
    return P.merge_latest(old, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("s09_ocr_words_to_pages", rf"""WITH {CHUNKS}, l AS (SELECT id AS page, i AS line, string_split(string_split(text, chr(10))[i], ' ') AS w FROM (SELECT id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM chunks)),
 w AS (SELECT page, line, j, w[j] AS word, CAST(length(w[j]) * 17 % 101 AS DOUBLE) AS conf FROM (SELECT page, line, w, unnest(range(1, len(w) + 1)) AS j FROM l)),
 g AS (SELECT * FROM w WHERE conf >= 40 AND trim(word) <> ''), t AS (SELECT page, line, string_agg(word, ' ' ORDER BY j) AS t, sum(conf) AS s, count(*) AS n FROM g GROUP BY ALL),
 p AS (SELECT page, string_agg(t, chr(10) ORDER BY line) AS text, round(sum(s) / sum(n) / 100, 3) AS confidence FROM t GROUP BY page)
 SELECT id AS page, md5(coalesce(p.text, '')) AS digest, coalesce(confidence, 0.0) AS confidence FROM chunks LEFT JOIN p ON page = id""".replace("SELECT id AS page, md5(coalesce(p.text", "SELECT chunks.id AS page, md5(coalesce(p.text").replace("LEFT JOIN p ON page = id", "LEFT JOIN p ON p.page = chunks.id"))
def s09(spark: SparkSession, sf: str) -> DataFrame:
    lines = chunks(spark, sf).select(F.col("id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("page", F.lit(0).alias("block"), F.lit(0).alias("par"), "line", F.posexplode(F.split("t", " ")).alias("i", "word"))
    got = P.ocr_words_to_pages(words.withColumn("conf", (F.length("word") * 17 % 101).cast("double")))
    return got.select("page", F.md5("text").alias("digest"), "confidence")


@query("s10_page_documents", f"""WITH {CHUNKS}, p AS (SELECT book, language AS part, row_number() OVER (PARTITION BY book, language ORDER BY page) - 1 AS page FROM chunks), s AS (SELECT book, part, max(page) + 1 AS n FROM p GROUP BY ALL),
 o AS (SELECT book, part, coalesce(sum(n) OVER (PARTITION BY book ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
 SELECT book, part, CAST(page AS INT) AS page, CAST(page + off AS BIGINT) AS book_page FROM p JOIN o USING (book, part) WHERE page >= 2 AND page <> 5""")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("book", "language").orderBy("page")) - 1
    pages = chunks(spark, sf).select("book", F.col("language").alias("part"), place.alias("page")).withColumn("skip", F.array(F.lit(5)))
    return P.page_documents(pages, first_skip=2).select("book", "part", "page", "book_page")


@query("s11_upload_guard", "SELECT source AS upload, bool_and(strlen(text) BETWEEN 100 AND 52428800) AND count(*) = 1 AS accepted FROM documents GROUP BY source")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("source").alias("upload"), F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("name"), F.octet_length("text").alias("bytes"))
    return U.guard_files(files)


EVENTS = "ev AS (SELECT event_id, user_id AS identity, event_type AS feature, ts FROM events)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("identity"), F.col("event_type").alias("feature"), "ts")


@query("w09_quota_decisions", f"""WITH {EVENTS}, r AS (SELECT *, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN feature = 'click' THEN 2 ELSE 1 END AS l FROM ev),
 n AS (SELECT *, row_number() OVER (PARTITION BY identity, feature, day ORDER BY ts, event_id) AS attempt FROM r)
 SELECT event_id, day, CAST(attempt AS INT) AS attempt, identity = 7 OR attempt <= l AS allowed, CASE WHEN identity <> 7 THEN CAST(greatest(0, l - attempt) AS INT) ELSE -1 END AS remaining FROM n""")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.when(F.col("feature") == "click", 2).otherwise(1)
    return U.quota_decisions(events(spark, sf), limit, exempt=F.col("identity") == 7).select("event_id", "day", "attempt", "allowed", F.coalesce("remaining", F.lit(-1)).alias("remaining"))


@query("r01_rate_limit")
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return U.rate_limit(events(spark, sf), "identity", limit=2, ttl=36000)


@query("r01_rate_limit_fixed")
def r01b(spark: SparkSession, sf: str) -> DataFrame:
    return U.rate_limit(events(spark, sf), "identity", limit=2, ttl=36000, mode="fixed")


@query("r02_daily_counts", f"WITH {EVENTS} SELECT identity, feature, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS used FROM ev GROUP BY ALL")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("identity", "feature", T.local_day("ts").alias("day")).agg(F.count("*").alias("used"))


def _streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream of its files. The pattern, which fits its name alone, lets the table be one file or a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("r02_daily_quota_stream", f"""WITH {EVENTS}, r AS (SELECT *, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN feature = 'click' THEN 2 ELSE 1 END AS l FROM ev),
 n AS (SELECT *, row_number() OVER (PARTITION BY identity, feature, day ORDER BY ts, event_id) AS attempt FROM r)
 SELECT event_id, day, identity = 7 OR attempt <= l AS allowed, CASE WHEN identity <> 7 THEN CAST(greatest(0, l - attempt) AS BIGINT) ELSE -1 END AS remaining FROM n""")
def r02_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events taken as a stream, in one trigger: each decision is made on arrival, from the key's state alone."""
    before = spark.conf.get(policy.STORE)
    with Scratch(spark) as scratch:
        policy.use_rocksdb(spark)
        try:
            ev = _streamed(spark, sf, "events").select("event_id", F.col("user_id").alias("identity"), F.col("event_type").alias("feature"), "ts")
            decided = policy.daily_quota_stream(ev, F.when(F.col("feature") == "click", 2).otherwise(1), exempt=F.col("identity") == 7)
            out = scratch.folder()
            policy.drain(decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder()).start())
        finally:
            spark.conf.set(policy.STORE, before)
        got = spark.read.schema(decided.schema).parquet(out)
        return cut(got.withColumn("remaining", F.coalesce("remaining", F.lit(-1).cast("long"))))


@query("r03_ingest_stream", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    """The documents ingested as a stream, and all of them a second time as after the loss of the checkpoint."""
    with Scratch(spark) as scratch:
        path = scratch.folder()
        for _ in range(2):
            ingest.ingest(_streamed(spark, sf, "documents"), path, scratch.folder(), key="doc_id").awaitTermination()
        return cut(ingest.current(spark, path, "doc_id").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest")))


@query("r04_reminder_audience", "SELECT DISTINCT user_id, 'afternoon' AS slot, 'user ' || user_id || ', your afternoon reading is ready' AS message FROM events WHERE event_type <> 'zzz' ORDER BY user_id LIMIT 300")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("user_id", F.concat(F.lit("user "), "user_id").alias("name"), F.lit(False).alias("expired")).distinct()
    return U.reminder_audience(users, 14)


@query("a23_reading_progress", "SELECT user_id, event_type AS book, max(CAST(floor(value) AS INT)) AS chapter FROM events GROUP BY ALL")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return U.reading_progress(table(spark, sf, "events").select("user_id", F.col("event_type").alias("book"), F.floor("value").cast("int").alias("chapter")))


@query("a23_bookmarks", "SELECT user_id, event_type AS item, count(*) % 2 = 1 AS marked FROM events GROUP BY ALL")
def a23b(spark: SparkSession, sf: str) -> DataFrame:
    return U.bookmarks(table(spark, sf, "events").select("user_id", F.col("event_type").alias("item")))


@query("w10_merge_turns", """WITH k AS (SELECT conv_id, turn // 2 AS t2, turn, CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'assistant' END AS role, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
 n AS (SELECT *, coalesce(lag(role) OVER w <> role, true)::INT AS new FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
 SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM r GROUP BY conv_id, run""")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 4 < 2, "user").otherwise("assistant"))
    return U.merge_turns(turns).select("conv_id", "run", "role", F.md5("text").alias("digest"), "turns")


@query("w11_recent_turns", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS back FROM conversations WHERE trim(text) <> '' QUALIFY back <= 3")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return U.recent_turns(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "back")


@query("w12_rapid_repeats", """SELECT event_id FROM (SELECT event_id, event_type, ts, lag(event_type) OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 WHERE NOT coalesce(p = event_type AND epoch_us(ts) - epoch_us(pt) < 36000000000, false)""")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), "ts", F.col("event_id").alias("turn"), F.col("event_type").alias("text"))
    return U.drop_rapid_repeats(turns, 36000).select(F.col("turn").alias("event_id"))


@query("w13_repeat_lines", rf"""WITH {CHUNKS}, l AS (SELECT id, i, string_split(text, chr(10))[i] AS t FROM (SELECT id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM chunks)),
 n AS (SELECT *, lower(trim(regexp_replace(t, '^\s*[\d•*\-]+[.)]?\s*', ''))) AS n FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY i) AS rn FROM n),
 k AS (SELECT * FROM f WHERE length(n) <= 45 OR rn = 1), b AS (SELECT *, last_value(CASE WHEN length(n) >= 30 THEN n END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k)
 SELECT id, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM b WHERE length(n) < 30 OR b IS NULL OR b <> n GROUP BY id""")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    return U.drop_repeat_lines(chunks(spark, sf).select("id", "text")).select("id", F.md5("text").alias("digest"))


@query("w14_dedupe_ids")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("id"), F.col("turn").alias("ts"), "text")
    return U.dedupe_ids(turns).select("conv_id", "id", "ts")


@query("j09_quote_grounded", rf"""WITH {CHUNKS}, e AS (SELECT id, lower(regexp_replace(text, '[^ऀ-ॿA-Za-z0-9]', '', 'g')) AS ev FROM chunks), q AS (SELECT item_id, lower(regexp_replace(text, '[^ऀ-ॿA-Za-z0-9]', '', 'g')) AS q FROM benchmark),
 w AS (SELECT item_id, substr(q, CAST(i AS INT), 20) AS w FROM (SELECT item_id, q, unnest(range(1, length(q) - 18, 4)) AS i FROM q WHERE length(q) >= 20))
 SELECT DISTINCT item_id AS quote_id, id AS doc_id FROM w JOIN e ON contains(ev, w)""")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    quotes = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return V.grounded_windows(quotes, table(spark, sf, "documents"))


@query("q09_answer_audit")
def q09(spark: SparkSession, sf: str) -> DataFrame:
    """Assistants' turns as answers, the turn before as the question, the document of the conversation's number as evidence."""
    turns = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = turns.withColumn("question", before).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "question", "text")
    d = chunks(spark, sf)
    passages = said.select("id", "conv_id").join(d.withColumnRenamed("id", "conv_id"), "conv_id").select("id", "book", "text", "page", F.col("book_title").alias("title"), F.lit(1).alias("rank"))
    names = d.select(F.col("book_title").alias("name"), "book").distinct()
    found = V.answer_audit(said.select("id", "question", "text"), passages.select("id", "book", "text"), names, passages.select("id", "rank", "title", "page"))
    return found.select("id", F.md5("text").alias("digest"), "quotes", "citations")


@query("f20_verify_answers")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    d = chunks(spark, sf)
    answers = d.select("id", F.concat(F.lit("He said “"), F.substring("text", 1, 80), F.lit("”.\n“"), F.reverse(F.substring("text", 1, 80)), F.lit("”\nTitle src3 says that "), F.substring("text", 1, 30), F.lit("\nend — Title src4 (p.1)")).alias("text"))
    names = d.select(F.col("book_title").alias("name"), "book").distinct()
    return V.verify_answers(answers, d.select("id", "book", "text"), names).select("id", F.md5("text").alias("digest"), "quotes", "citations")


@query("a19_repair_scorecard", rf"""WITH {CHUNKS}, p AS (SELECT text AS a, regexp_replace(text, '[A-Za-z0-9]', '', 'g') AS b FROM chunks), n AS (SELECT a, b,
 len(list_filter(string_split_regex(a, '\s+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9]{{0,12}}$'))) AS x, len(list_filter(string_split_regex(b, '\s+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9]{{0,12}}$'))) AS y FROM p)
 SELECT CAST(sum(x) AS BIGINT) AS bad_before, CAST(sum(y) AS BIGINT) AS bad_after, round(100 * (sum(x) - sum(y)) / greatest(sum(x), 1), 4) AS improved_percent, count(*) FILTER (WHERE abs(length(b) - length(a)) > 0.2 * length(a)) AS length_changed FROM n""")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    pairs = chunks(spark, sf).select(F.col("text").alias("before"), F.regexp_replace("text", "[A-Za-z0-9]", "").alias("after"))
    return V.repair_scorecard(pairs, T.bad_token_count("before"), T.bad_token_count("after"))


def _almanac_sql() -> str:
    turn = lambda x: f"((({x}) % 360.0 + 360.0) % 360.0)"

    def sun(t: str) -> str:
        m = f"radians({turn(f'357.52911 + 35999.05029 * {t} - 0.0001537 * {t} * {t}')})"
        c = f"(1.914602 - 0.004817 * {t} - 0.000014 * {t} * {t}) * sin({m}) + (0.019993 - 0.000101 * {t}) * sin(2 * {m}) + 0.000289 * sin(3 * {m})"
        return turn(f"{turn(f'280.46646 + 36000.76983 * {t} + 0.0003032 * {t} * {t}')} + {c}")

    def angle(a: float, b: float, c: float) -> str:
        return f"radians({turn(f'{a} + {b} * t + {c} * t * t')})"

    terms = " + ".join(f"({x}) * sin({' + '.join(f'{k} * {v}' for k, v in zip(times, ('d', 'm', 'mp', 'f'), strict=True))})" for x, *times in A.MOON)
    return f"""WITH j AS (SELECT event_id, ts, epoch_us(ts) / 8.64e10 + 2440587.5 AS jd FROM events), c AS (SELECT *, (jd - 2451545.0) / 36525 AS t FROM j),
 a AS (SELECT *, {angle(297.8501921, 445267.1114034, -0.0018819)} AS d, {angle(357.5291092, 35999.0502909, -0.0001536)} AS m, {angle(134.9633964, 477198.8675055, 0.0089970)} AS mp, {angle(93.2720950, 483202.0175233, -0.0036539)} AS f,
 {sun('t')} AS sun, 23.85 + 0.013971 * t * 100 AS ay FROM c), b AS (SELECT *, {turn(f"{turn('218.3164477 + 481267.88123421 * t - 0.0015786 * t * t')} + {terms}")} AS moon FROM a)
 SELECT event_id, CAST(floor({turn('moon - sun')} / 12) AS INT) AS tithi, CAST(floor({turn('moon - ay')} / (360.0 / 27)) AS INT) AS nakshatra, CAST(floor({turn(f"{turn('sun - ay')} + {turn('moon - ay')}")} / (360.0 / 27)) AS INT) AS yoga,
 CAST(floor({turn('sun - ay')} / 60) AS INT) AS ritu, CAST(dayofweek(ts) AS INT) AS weekday, CAST(year(ts) + CASE WHEN month(ts) >= 4 THEN 57 ELSE 56 END AS INT) AS samvat_year FROM b"""


@query("c06_almanac", _almanac_sql())
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return A.add_almanac(table(spark, sf, "events"), "ts").select("event_id", "tithi", "nakshatra", "yoga", "ritu", "weekday", "samvat_year")


@query("c07_almanac_details")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return A.add_almanac(table(spark, sf, "events"), "ts", 28.6, 77.2).select("event_id", "paksha", "pada", "karana", "muhurta", "lunar_month")


@query("c09_almanac_names")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    named = A.almanac_names(A.add_almanac(table(spark, sf, "events"), "ts"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("hi"))
    return named.select("event_id", "tithi_name", "muhurta_name")
