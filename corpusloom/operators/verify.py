"""Grounding: quotes and citations of answers against the evidence, footers, topic rules and scorecards."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import disclaims, has_sentences, is_health_query, looks_garbled, norm_evidence, strip_self_citation
from ..functions.translit import repair_homoglyphs
from ..profiles import ScriptProfile
from ..session import Scratch, cut
from .phrases import containing_phrases
from .usage import drop_repeat_lines


def quote_in(quote: Column, evidence: Column, width: int = 20, stride: int = 4, least: int = 12) -> Column:
    """Both normalised: a quote under `least` characters, one contained whole, or by any window of `width`, is grounded."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(quote) - width + 1, F.lit(1)), F.lit(stride))
    part = F.exists(starts, lambda i: F.contains(evidence, F.substr(quote, i, F.lit(width))))
    return (F.length(quote) < least) | F.contains(evidence, quote) | ((F.length(quote) > width) & part)


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows along the last axis of code points: polynomials, put together from windows of doubled widths."""
    base = 0x9E3779B97F4A7C15
    out, done, part, size = None, 0, codes, 1
    while True:
        if width & size:  # `part` holds windows of `size`
            out = part if out is None else out[..., : part.shape[-1] - done] * np.uint64(pow(base, size, 1 << 64)) + part[..., done:]
            done += size
        if done == width:
            break
        part = part[..., : part.shape[-1] - size] * np.uint64(pow(base, size, 1 << 64)) + part[..., size:]
        size *= 2
    return out ^ (out >> np.uint64(32))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _scanned(texts: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """`(doc_id, w)`: the windows that stand in a text (doc_id, t), found by their hashes; nothing else leaves the scan."""
    wanted = [r["w"] for r in windows.select("w").distinct().collect()]
    hashes = np.unique(_window_hashes(_codes(wanted).reshape(-1, width), width)) if wanted else np.zeros(0, np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(hashes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value
        some = np.zeros(1 << 20, bool)
        some[(hashes >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            docs, found = [], []
            for doc, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if len(t) < width:
                    continue
                own = _window_hashes(_codes([t]), width)
                at = np.flatnonzero(some[(own >> np.uint64(44)).astype(np.int64)])
                at = at[hashes[np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)] == own[at]]  # sorted once, for all texts
                met = {t[i : i + width] for i in at.tolist()}
                docs += [doc] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string())], ["doc_id", "w"])

    return texts.select(F.col("doc_id").cast("long"), "t").mapInArrow(scan, "doc_id long, w string")


def _spread(texts: DataFrame, width: int, block: int = 2000) -> DataFrame:
    """`(doc_id, w)`: every window of the texts. They are cut into blocks first, so that substr stays short."""
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - width) / block))
    cut = texts.select("doc_id", F.explode(F.transform(starts, lambda b: F.substr("t", (b * block + 1).cast("int"), F.lit(block + width - 1)))).alias("b"))
    return cut.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - width + 1), lambda i: F.substr("b", i, F.lit(width)))).alias("w"))


def grounded_windows(quotes: DataFrame, evidence: DataFrame, width: int = 20, stride: int = 4, most: int = 1_000_000) -> DataFrame:
    """`(quote_id, doc_id)` where a window of the quote (at the stride) stands in the document: all documents at once.

    Both are normalised first. Up to `most` windows of quotes (quote_id, text) go to the scan of the documents (doc_id,
    text), which puts out only those it finds; more of them are joined with the windows at every place of the documents.
    Either way windows meet as texts in the end, so the pairs are the same."""
    q = quotes.select("quote_id", norm_evidence("text").alias("t")).where(F.length("t") >= width)
    q = q.select("quote_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - width + 1, F.lit(stride)), lambda i: F.substr("t", i, F.lit(width)))).alias("w"))
    # short texts are left out by the scan itself: a filter here would normalise every text twice
    d = evidence.select("doc_id", norm_evidence("text").alias("t"))
    found = _scanned(d, q, width) if q.count() <= most else _spread(d.where(F.length("t") >= width), width)
    return found.join(q, "w").select("quote_id", "doc_id").distinct()


#: What stands behind a book's name where a sentence attributes something to it.
ATTRIBUTIONS = (
    r"के\s+अनुसार|के\s+मुताबिक|में\s+(?:कहा|लिखा|बताया)\s+गया\s+है\s+कि|में\s+वर्णित\s+है\s+कि|according\s+to|says\s+that|states\s+that"
)


def verify_answers(answers: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """answers (id, text) with quotes that the evidence (id, book, text) doesn't hold removed line by line, and
    attributions to books (name, book) that aren't among it: `(id, text, quotes, citations)`.

    All ungrounded names that a line holds lose their attribution. A citation behind a dash at the line's end goes if
    it holds an ungrounded name and no grounded one, compared as normalised text.
    """
    with Scratch(answers.sparkSession) as scratch:
        ground = evidence.groupBy("id").agg(
            norm_evidence(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book", "text"))), lambda x: x["text"]), " ")).alias("ev"), F.collect_set("book").alias("books"))
        met_once = answers.join(ground, "id", "left").select("id", "books", F.coalesce("ev", F.lit("")).alias("ev"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
        # as columns of their own, so that a window doesn't normalise its quote again; lines are read three times, judged once
        quoted = met_once.withColumn("said", F.regexp_extract("line", r'["“”«»]([^"“”«»\n]{10,400})["“”«»]', 1)).withColumn("quote", norm_evidence("said"))
        lines = scratch.staged(quoted.select("id", "i", "line", "books", ((F.col("said") != "") & ~quote_in(F.col("quote"), F.col("ev"))).alias("bad")))
        named = names.where(F.length("name") >= 4).withColumn("normed", norm_evidence("name"))
        cited = F.regexp_extract("line", r"\s*[—–]\s*([^\n—–]{3,60})\s*$", 1)
        # the names that a line holds as they are, or as normalised text in what it cites at its end, by an automaton of each
        good = lines.where("not bad").select("id", "i", "line", "books", norm_evidence(cited).alias("tail"))
        plain = containing_phrases(good, F.col("line"), named, "name").withColumnRenamed("phrase", "name").join(named, "name")
        behind = containing_phrases(good, F.col("tail"), named, "normed").withColumnRenamed("phrase", "normed").join(named, "normed")
        met = plain.unionByName(behind).distinct()
        grounded = F.coalesce(F.array_contains(F.coalesce("books", F.array().cast("array<string>")), F.col("book")), F.lit(False))
        in_tail = F.contains("tail", "normed")
        escaped = F.regexp_replace("name", r"([.*+?^${}()|\[\]\\])", r"\\$1")
        by_length = F.array_sort(F.collect_set(F.when(~grounded, F.struct((-F.length("name")).alias("n"), escaped.alias("name")))))
        per = met.groupBy("id", "i").agg(by_length.alias("wrong"), F.bool_or(in_tail & grounded).alias("kept"), F.bool_or(in_tail & ~grounded).alias("dropped"))
        lines = lines.join(per, ["id", "i"], "left")
        either = F.array_join(F.transform("wrong", lambda x: x["name"]), "|")
        attribution = F.concat(F.lit("(?i)("), either, F.lit(rf")\s*(?:{ATTRIBUTIONS})\s*[,:—-]?\s*"))
        any_wrong = F.coalesce(F.size("wrong") > 0, F.lit(False))
        found = F.when(any_wrong, F.size(F.array_distinct(F.regexp_extract_all("line", attribution, F.lit(1))))).otherwise(0)
        new = F.when(any_wrong, F.regexp_replace("line", attribution, F.lit(""))).otherwise(F.col("line"))
        tail = F.coalesce(F.col("dropped") & ~F.col("kept"), F.lit(False))
        lines = lines.withColumn("n", found + tail.cast("int")).withColumn("new", F.when(tail, F.regexp_replace(new, r"\s*[—–]\s*[^\n—–]{3,60}\s*$", "")).otherwise(new))
        out = lines.groupBy("id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("bad"), F.struct("i", "new")))), lambda x: x["new"]), "\n").alias("text"),
            F.count_if("bad").alias("quotes"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("citations"))
        return cut(out.withColumn("text", F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n"))))


def citations(grounded: DataFrame, most: int = 4, pages: int = 2) -> DataFrame:
    """grounded (id, rank, title, page) to a footer per id: titles by first appearance; rows after the first one of the
    last title are not looked at; the first pages of each."""
    first = grounded.withColumn("f", F.min("rank").over(Window.partitionBy("id", "title")))
    first = first.withColumn("t", F.dense_rank().over(Window.partitionBy("id").orderBy("f", "title")))
    stop = F.coalesce(F.min(F.when(F.col("t") == most, F.col("rank"))).over(Window.partitionBy("id")), F.lit(1 << 30))
    seen = first.withColumn("stop", stop).where(F.col("rank") <= F.col("stop"))
    per = seen.groupBy("id", "t", "title").agg(F.slice(F.array_sort(F.collect_set("page")), 1, pages).alias("p"))
    text = F.when(F.size("p") > 0, F.concat("title", F.lit(" (p."), F.array_join(F.col("p").cast("array<string>"), ", p."), F.lit(")"))).otherwise(F.col("title"))
    return per.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", text.alias("x")))), lambda y: y["x"]), " · ").alias("footer"))


#: The mark of a footer, and the note under an answer about health.
FOOTER, NOTE = "📚 *Aadhaar: ", "_⚕️ This is what the scriptures say — not medical advice. Please do consult a doctor._"


def answer_audit(answers: DataFrame, evidence: DataFrame, names: DataFrame, grounded: DataFrame, note: str = NOTE) -> DataFrame:
    """`(id, text, quotes, citations)` of answers (id, question, text), as they may be shown.

    Look-alike letters are repaired, self-citations and repeated lines dropped, and quotes and attributions that the
    evidence (id, book, text) doesn't hold removed. An answer with grounded passages (id, rank, title, page) gets their
    footer, unless it admits to have found nothing or cites itself; one to a question about health gets the note.
    """
    repaired, _ = repair_homoglyphs("text")
    clean = drop_repeat_lines(answers.select("id", "question", strip_self_citation(repaired).alias("text")))
    checked = verify_answers(clean.select("id", "text"), evidence, names)
    about = clean.select("id", is_health_query("question").alias("health"), disclaims("text").alias("nothing"))
    out = checked.join(about, "id").join(citations(grounded), "id", "left")
    text = F.coalesce("text", F.lit(""))
    foot = F.when(F.col("footer").isNotNull() & ~F.col("nothing") & ~text.contains("📚 Aadhaar"), F.concat(F.lit("\n\n---\n" + FOOTER), "footer", F.lit("*")))
    advice = F.when(F.col("health") & ~text.contains("⚕️"), F.lit("\n\n" + note))
    shown = F.when(text != "", F.concat(text, F.coalesce(foot, F.lit("")), F.coalesce(advice, F.lit("")))).otherwise("")
    return out.select("id", shown.alias("text"), "quotes", "citations")


def grounded_flags(rows: DataFrame, p: ScriptProfile, least: float = 0.5) -> DataFrame:
    """rows (rerank, text) with `grounded`: passed the gate, holds sentences, isn't garbled. A null rerank never is."""
    return rows.withColumn("grounded", F.coalesce(F.col("rerank") >= least, F.lit(False)) & has_sentences("text", p) & ~looks_garbled("text", p))


def context_block(rows: DataFrame) -> DataFrame:
    """rows (id, pos, title, chapter, verse, page, score, text) as one prompt block per id."""
    src = F.concat_ws(" · ", "title", F.concat(F.lit("Ch."), F.col("chapter").cast("string")), F.concat(F.lit("Verse "), F.col("verse").cast("string")), F.concat(F.lit("p."), F.col("page").cast("string")))
    relevance = F.coalesce(F.concat(F.lit(" [relevance: "), F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit("%]")), F.lit(""))
    block = F.concat(F.lit("[PASSAGE "), F.col("pos").cast("string"), F.lit(" — "), src, relevance, F.lit("]\n"), F.col("text"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def topic_flags(df: DataFrame, rules: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """`(key, topic)`: the first topic (topic, pattern, prio; any number of them) with a pattern that the text contains."""
    own = rules.select("topic", F.lower("pattern").alias("phrase"), "prio")
    met = containing_phrases(df.select(key, F.lower(text).alias("t")), F.col("t"), own, "phrase").join(own, "phrase")
    return met.groupBy(key).agg(F.min_by("topic", "prio").alias("topic"))


def scorecard(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (config, query_id, grounded, text), expected (query_id, words, control): per config the percent of
    questions with a grounded row, with one that holds an expected word, and the false citations of control questions."""
    met = F.exists("words", lambda w: F.contains(F.lower("text"), F.lower(w)))
    per = expected.join(results, "query_id", "left").groupBy("config", "query_id", "control").agg(
        F.coalesce(F.bool_or("grounded"), F.lit(False)).alias("g"), F.coalesce(F.bool_or(F.col("grounded") & met), F.lit(False)).alias("h"))
    asked = F.greatest(F.count_if(~F.col("control")), F.lit(1))
    return per.where("config is not null").groupBy("config").agg(
        F.round(100 * F.count_if(~F.col("control") & F.col("g")) / asked, 4).alias("grounded_percent"),
        F.round(100 * F.count_if(~F.col("control") & F.col("h")) / asked, 4).alias("hit_percent"), F.count_if(F.col("control") & F.col("g")).alias("false_citations"))


def repair_scorecard(pairs: DataFrame, bad: Column, bad_after: Column) -> DataFrame:
    """pairs (before, after): noise tokens before and after, improvement, and texts whose length changed by over a fifth."""
    drift = F.abs(F.length("after") - F.length("before")) > 0.2 * F.length("before")
    return pairs.agg(F.sum(bad).alias("bad_before"), F.sum(bad_after).alias("bad_after"), F.round(100 * (F.sum(bad) - F.sum(bad_after)) / F.greatest(F.sum(bad), F.lit(1)), 4).alias("improved_percent"), F.count_if(drift).alias("length_changed"))
