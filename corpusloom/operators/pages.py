"""Page-level operators: near-duplicate pages, structure, parts, summaries, samples, resume and merge."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Col, _c
from ..session import Scratch, cut
from .ranks import ordered, places


def word_trigrams(c: Col) -> Column:
    """Hashes of the distinct three-word windows of a text."""
    w = F.array_remove(F.split(_c(c), r"\s+"), "")
    n = F.greatest(F.size(w) - 2, F.lit(0))
    # three shifted slices side by side: no lookups by place within the lambda
    return F.array_distinct(F.transform(
        F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n)), lambda x: F.xxhash64(x["0"], x["1"], x["2"])
    ))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def like_previous(pages: DataFrame, scratch: Scratch, keep: Sequence[str] = ("book", "page")) -> DataFrame:
    """Columns `keep` of `pages` (book, page, text), with `similarity` to the page before in the book; null on its first.

    Texts are shuffled once, into ranges of the order, and one pass over each holds the trigram hashes of one page. Only
    those of a range's first and last page are written, for its first is compared with the last of the range before.
    """
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = pages.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col("book").alias("_b"), F.col("page").alias("_p"), F.col("text").alias("_x"))
    laid = laid.repartitionByRange(ranges, "_b", "_p").sortWithinPartitions("_b", "_p")
    laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_t", word_trigrams("_x")).drop("_p", "_x")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = ending = None
        for batch in batches:
            *kept, books, parts, grams = batch.columns
            ends, likes, edges = [], [], []
            for i, book in enumerate(books.to_pylist()):
                found = grams[i].values
                own = np.sort(found.to_numpy(zero_copy_only=False)) if found is not None else np.zeros(0, np.int64)
                ends.append("first" if last is None else None)
                edges.append(own if last is None else None)
                if last is None or book != now:
                    likes.append(None)
                else:
                    both = len(np.intersect1d(own, last, assume_unique=True))
                    likes.append(both / (len(own) + len(last) - both) if both else 0.0)
                now, last = book, own
            named = [*kept, books, parts, pa.array(ends, pa.string()), pa.array(likes, pa.float64()), pa.array(edges, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(named, names)
            ending = [*(pa.nulls(1, c.type) for c in kept), books[-1:], parts[-1:]] if len(books) else ending
        if last is not None:
            yield pa.RecordBatch.from_arrays([*ending, pa.array(["last"]), pa.nulls(1, pa.float64()), pa.array([last], pa.list_(pa.int64()))], names)

    names = [*laid.columns[:-1], "_end", "similarity", "_edge"]
    kinds = [f"{name} {kind}" for name, kind in laid.dtypes[:-1]]
    laid = scratch.staged(laid.mapInArrow(fold, ", ".join([*kinds, "_end string", "similarity double", "_edge array<bigint>"])))
    # a row for each range from here on; what is carried is the number of the range before
    lasts = laid.where("_end = 'last'")
    firsts = laid.where("_end = 'first'").join(lasts.select("_part", F.lag("_part").over(Window.orderBy("_part")).alias("_q")), "_part")
    lasts = lasts.select(F.col("_part").alias("_q"), F.col("_b").alias("_c"), F.col("_edge").alias("_before"))
    met = firsts.join(lasts, "_q").where(F.col("_b").eqNullSafe(F.col("_c"))).select("_part", F.lit("first").alias("_end"), jaccard(F.col("_edge"), F.col("_before")).alias("_s"))
    every = laid.where("_end is null or _end = 'first'").join(F.broadcast(met), ["_part", "_end"], "left")
    return every.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.coalesce("similarity", "_s").alias("similarity"))


def flag_duplicate_pages(pages: DataFrame, threshold: float = 0.85, mode: str = "last_accepted", keep: Sequence[str] | None = None) -> DataFrame:
    """`pages` (book, page, text, usable), or its columns `keep`, with `duplicate`.

    previous: like the page before it. last_accepted: like the last page of the book that was usable and no duplicate: one
    pass over the sorted pages of each book, which holds the trigram hashes of that last page alone.
    """
    if mode == "previous":
        with Scratch(pages.sparkSession) as scratch:
            met = like_previous(pages, scratch, keep or pages.columns)
            return cut(met.withColumn("duplicate", F.coalesce(F.col("similarity") > threshold, F.lit(False))).drop("similarity"))
    grams = pages.withColumn("_t", word_trigrams("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), np.zeros(0, np.int64)
        for batch in batches:
            flags = []
            for i, (book, usable) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if book != now:
                    now, last = book, np.zeros(0, np.int64)
                found = batch.column(3)[i].values
                own = np.sort(found.to_numpy(zero_copy_only=False)) if found is not None else np.zeros(0, np.int64)
                both = len(np.intersect1d(own, last, assume_unique=True))
                flags.append(bool(both) and both / (len(own) + len(last) - both) > threshold)
                if usable and not flags[-1]:
                    last = own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.bool_())], ["book", "page", "duplicate"])

    kinds = dict(pages.dtypes)
    ordered = grams.select("book", "page", "usable", "_t").repartition("book").sortWithinPartitions("book", "page")
    flags = ordered.mapInArrow(fold, f"book {kinds['book']}, page {kinds['page']}, duplicate boolean")
    return pages.join(flags, ["book", "page"]).select(*(keep or pages.columns), "duplicate")


#: What opens a chapter, a section and a verse.
CHAPTER = (
    r"(?i)(?:अध्याय|अधयाय|adhyay)\s*[–\-:]?\s*([०-९\d]+)", r"(?i)(?:chapter|CH\.?)\s*[–\-:]?\s*(\d+)",
    r"(?i)(?:काण्ड|कान्ड|kanda)\s*[–\-:]?\s*([०-९\w]+)", r"(?i)(?:सर्ग|सग|Sarga)\s*[–\-:]?\s*([०-९\d]+)",
    r"(?i)(?:मण्डल|mandal)\s*[–\-:]?\s*([०-९\d]+)", r"(?:CHAPTER|अध्याय)\s+([A-Z0-9०-९]+)",
)
SECTION = (r"(?i)(?:खण्ड|khand|section)\s*[–\-:]?\s*([०-९\d]+)", r"(?i)(?:पर्व|parva)\s*[–\-:]?\s*([०-९\w]+)")
VERSE = (r"[।॥]\s*(?:\d+[.\-]\d+|\d+)\s*[।॥]", r"\|\|\s*\d+\s*\|\|", r"(?i)(?:श्लोक|shlok)\s*(\d+)")


def classify_lines(pages: DataFrame, chapter=CHAPTER, section=SECTION, verse=VERSE) -> DataFrame:
    """`(book, page, line, text, kind, num)`: C, S, V or null, first match wins; num where the number can be read."""
    lines = pages.select("book", "page", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    kind = num = None
    number = F.lit(None).cast("int")
    for name, patterns in (("C", chapter), ("S", section), ("V", verse)):
        for p in patterns:
            hit = F.col("text").rlike(p)
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
            digits = F.translate(F.regexp_extract("text", p, 1), "०१२३४५६७८९", "0123456789").try_cast("int") if name != "V" else number
            num = F.when(hit, digits) if num is None else num.when(hit, digits)
    return lines.select("*", kind.alias("kind"), num.alias("num"))


#: What a stretch of lines does to the state before it: the last number read for chapter and section and what was added
#: since, the last title, and whether section and verse began anew in it.
CHANGE = "c_val int, c_add int, title string, s_new boolean, s_val int, s_add int, v_new boolean, v_add int"


def _changes(mode: str):
    """A fold over sorted lines (book, page, line, kind, num, title): to each what its book's lines have done since the
    range began, and whether its book is the range's first, which may go on from the range before."""
    from pyspark import TaskContext

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        book, first = object(), None
        for batch in batches:
            out = []
            for own, kind, num, title in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if own != book:
                    first = first is None
                    book, c_val, c_add, name, s_new, s_val, s_add, v_new, v_add = own, None, 0, None, False, None, 0, False, 0
                if mode == "strict":
                    c_val = num if kind in ("C", "S") and num is not None else c_val
                elif kind == "C":
                    c_val, c_add = (num, 0) if num is not None else (c_val, c_add + 1)
                    name, s_new, s_val, s_add, v_new, v_add = title, True, None, 0, True, 0
                elif kind == "S":
                    s_val, s_add = (num, 0) if num is not None else (s_val, s_add + 1)
                    v_new, v_add = True, 0
                elif kind == "V":
                    v_add += 1
                out.append((part, at, first, c_val, c_add, name, s_new, s_val, s_add, v_new, v_add))
                at += 1
            columns = zip(*out, strict=True) if out else [()] * 11
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], ["book", "page", "line", "_part", "_at", "_first", *(x.split()[0] for x in CHANGE.split(", "))])

    return fold


def _after(c: dict, before: tuple) -> tuple:
    """The state (chapter, title, section, verse) behind a stretch of lines, from the one before it."""
    chapter, title, section, verse = before
    section, verse = None if c["s_new"] else section, None if c["v_new"] else verse
    grown = lambda old, add: (old or 0) + add if add else old
    return (
        grown(chapter if c["c_val"] is None else c["c_val"], c["c_add"]), c["title"] if c["title"] is not None else title,
        grown(section if c["s_val"] is None else c["s_val"], c["s_add"]), grown(verse, c["v_add"]),
    )


def _scanned_structure(lines: DataFrame, mode: str, scratch: Scratch) -> DataFrame:
    """`book, page, line, chapter, chapter_title, section, verse` of lines (book, page, line, kind, num, title).

    A prefix scan over ranges of (book, page, line): every range notes in each line what its lines have done so far. How
    a stretch changes the state is one small record, and records follow each other, so the state that a range begins with
    comes from the last record of each range before it: one row a range goes to the driver. It is joined to the lines of
    the range's first book alone; a book of any size runs in many tasks.
    """
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(lines.dtypes)
    laid = lines.select("book", "page", "line", "kind", "num", "title").repartitionByRange(ranges, "book", "page", "line").sortWithinPartitions("book", "page", "line")
    schema = f"book {kinds['book']}, page {kinds['page']}, line {kinds['line']}, _part int, _at long, _first boolean, {CHANGE}"
    seen = scratch.staged(laid.mapInArrow(_changes(mode), schema))
    ends = seen.groupBy("_part").agg(F.max_by(F.struct("book", "_first", *(x.split()[0] for x in CHANGE.split(", "))), "_at").alias("e"), F.min_by("book", "_at").alias("opens"))
    carried, book, state = [], None, (None,) * 4
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row for each range
        goes_on = r["opens"] == book and book is not None
        if goes_on:
            carried.append((r["_part"], True, *state))
        # the range's last book begins in it, unless it is its first one too
        state = _after(r["e"].asDict(), state if r["e"]["_first"] and goes_on else (None,) * 4)
        book = r["e"]["book"]
    table = lines.sparkSession.createDataFrame(carried, "_part int, _first boolean, _c int, _title string, _s int, _v int")
    out = seen.join(F.broadcast(table), ["_part", "_first"], "left")
    grown = lambda old, add: F.when(F.col(add) > 0, F.coalesce(old, F.lit(0)) + F.col(add)).otherwise(old)
    section = F.coalesce("s_val", F.when(~F.col("s_new"), F.col("_s")))
    return out.select(
        "book", "page", "line", grown(F.coalesce("c_val", "_c"), "c_add").alias("chapter"), F.coalesce("title", "_title").alias("chapter_title"),
        grown(section, "s_add").alias("section"), grown(F.when(~F.col("v_new"), F.col("_v")), "v_add").alias("verse"),
    )


def _marks(lines: DataFrame) -> DataFrame:
    """Lines with what a scan needs of them."""
    return lines.withColumn("title", F.when(F.col("kind") == "C", F.substring(F.trim("text"), 1, 120)))


def running_structure(lines: DataFrame, mode: str = "increment", scratch: Scratch | None = None) -> DataFrame:
    """Lines (book, page, line, text, kind, num) with the running chapter, chapter_title, section and verse.

    increment: a number that can't be read is one more than the last; strict: sections count as chapters and such a
    heading is passed over, and there is a chapter alone. See _scanned_structure for how; without `scratch` the result is
    written to the checkpoint folder. A null book has no state carried between ranges.
    """
    if scratch is None:
        with Scratch(lines.sparkSession) as own:
            return cut(running_structure(lines, mode, own))
    state = _scanned_structure(_marks(lines), mode, scratch)
    if mode == "strict":
        state = state.drop("chapter_title", "section", "verse")
    return lines.join(state, ["book", "page", "line"])


def page_structure(pages: DataFrame, scratch: Scratch | None = None, mode: str = "increment", **patterns) -> DataFrame:
    """Per page, the state after its last line; a page without text carries that of the page before.

    Only lines that mark something are scanned, and one row for the end of each page."""
    if scratch is None:
        with Scratch(pages.sparkSession) as own:
            return cut(page_structure(pages, own, mode, **patterns))
    last = (1 << 31) - 1
    marks = _marks(classify_lines(pages, **patterns)).where("kind is not null").select("book", "page", "line", "kind", "num", "title")
    none = F.lit(None)
    ends = pages.select("book", "page", F.lit(last).alias("line"), none.cast("string").alias("kind"), none.cast("int").alias("num"), none.cast("string").alias("title"))
    return _scanned_structure(marks.unionByName(ends), mode, scratch).where(F.col("line") == last).drop("line")


def detect_sections(docs: DataFrame, heading: str = r"(?i)^(?:chapter|section|part|unit|topic|module|lesson)\s+(\d+|[ivxlc]+)[:.]\s*(.+)",
                    least: int = 100) -> DataFrame:
    """`(id, section, title, content)`: a heading line under 120 characters opens a section; one before another heading
    is kept if its content has over `least` characters, the last one if it has any; a single section is the document."""
    t = F.trim("t")
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("h", t.rlike(heading) & (F.length(t) < 120))
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count_if("h").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("i", "t")))), lambda x: x["t"]), "\n")
    parts = lines.groupBy("id", "section").agg(F.coalesce(F.max(F.when(F.col("h"), t)), F.lit("Introduction")).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))
    last = Window.partitionBy("id")
    parts = parts.withColumn("_last", F.col("section") == F.max("section").over(last))
    parts = parts.where(F.when(F.col("_last"), F.length("content") > 0).otherwise(F.length("content") > least))
    parts = parts.withColumn("_n", F.count("*").over(last)).join(docs.select("id", F.col("text").alias("_text")), "id")
    single = F.col("_n") == 1
    return parts.select("id", "section", F.when(single, "Full Document").otherwise(F.col("title")).alias("title"), F.when(single, F.col("_text")).otherwise(F.col("content")).alias("content"))


def page_parts(chunks: DataFrame, size: int = 50) -> DataFrame:
    """Fixed ranges of `size` pages from a book's first page: part, page range, chunks and characters."""
    first = chunks.groupBy("book").agg(F.min("page").alias("first"))
    part = F.floor((F.col("page") - F.col("first")) / size).cast("int")
    return chunks.join(first, "book").groupBy("book", part.alias("part")).agg(
        F.min("page").alias("page_from"), F.max("page").alias("page_to"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
    )


def extraction_summary(pages: DataFrame) -> DataFrame:
    """Per book and in total (null book): pages ok, failed, skipped, characters and mean confidence of the ok ones."""
    ok = F.col("status") == "ok"
    return pages.rollup("book").agg(
        F.count_if(ok).alias("ok"), F.count_if(F.col("status").isin("blank", "low_conf")).alias("failed"),
        F.count_if(F.col("status") == "duplicate").alias("skipped"), F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("chars"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("confidence"))), F.lit(0.0)) / F.greatest(F.count_if(ok), F.lit(1)), 6).alias("avg_confidence"),
    )


def scanned_documents(pages: DataFrame, least: int = 30, early_pages: int = 10, early_least: int = 20, long: int = 15) -> DataFrame:
    """Per book: words of three letters or more, and whether so few of them mean that it is scanned images."""
    n = F.regexp_count("text", F.lit(r"\p{L}{3,}"))
    out = pages.groupBy("book").agg(F.sum(n).alias("words"), F.sum(F.when(F.col("page") <= early_pages, n).otherwise(0)).alias("early"), F.count("*").alias("pages"))
    return out.select("book", "words", ((F.col("words") < least) | ((F.col("pages") > long) & (F.col("early") < early_least))).alias("scanned"))


def pending(every: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return every.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: a new row wins, old rows of other keys stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def _placed(df: DataFrame, scratch: Scratch) -> DataFrame:
    return places(df, "book", "page", "id", scratch=scratch).drop("row")


def even_sample(chunks: DataFrame, n: int, least: int = 450, scratch: Scratch | None = None) -> DataFrame:
    """Per book every step-th chunk over `least` characters, step being their number over n (at least 1); of a book that
    has none of that length, its 2n longest chunks.

    Without `scratch` the result is written to the checkpoint folder."""
    if scratch is None:
        with Scratch(chunks.sparkSession) as own:
            return cut(even_sample(chunks, n, least, own))
    long = F.length("text") > least
    placed = _placed(chunks.where(long), scratch)
    out = placed.where(F.pmod("i", F.greatest(F.floor(F.col("c") / n), F.lit(1))) == 0).drop("i", "c")
    without = chunks.groupBy("book").agg(F.coalesce(F.max(long), F.lit(False)).alias("_l")).where("not _l").select("book")
    ranked = chunks.join(without, "book", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc(F.length("text")), "page", "id")))
    return out.unionByName(ranked.where(F.col("_r") <= 2 * n).drop("_r"))


def middle_sample(pages: DataFrame, n: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """Per book pages between a quarter and three quarters of it, at a fixed step."""
    if scratch is None:
        with Scratch(pages.sparkSession) as own:
            return cut(middle_sample(pages, n, own))
    placed = _placed(pages, scratch)
    low, high = F.floor(F.col("c") / 4), F.floor(F.col("c") * 3 / 4)
    step = F.greatest(F.lit(1), F.floor((high - low) / n))
    return placed.where((F.col("i") >= low) & (F.col("i") < high) & (F.pmod(F.col("i") - low, step) == 0)).drop("i", "c")


def daily_pick(items: DataFrame, day: Column, mode: str = "dayofyear", scratch: Scratch | None = None) -> DataFrame:
    """Per book the item whose place is the day of the year modulo their number; mode dayofmonth: one item of all, by the
    day of the month."""
    if scratch is None:
        with Scratch(items.sparkSession) as own:
            return cut(daily_pick(items, day, mode, own))
    if mode == "dayofmonth":
        laid = ordered(items, "book", "page", "id", scratch=scratch)
        n = laid.agg(F.count("*")).first()[0]
        return laid.where(F.col("row") == F.pmod(F.dayofmonth(day), F.lit(max(n, 1)))).drop("row")
    return _placed(items, scratch).where(F.col("i") == F.pmod(F.dayofyear(day), F.col("c"))).drop("i", "c")


def resolve_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """`(expected, file)`: the exact name, else the only file that is equal but for case and marks, else the only one that
    holds all the expected name's words, else null. Names meet by equality of what is compared: no pair is tried that
    shares nothing."""
    plain = lambda c: F.replace(F.lower(c), F.lit(".pdf"), F.lit(""))
    norm = lambda c: F.regexp_replace(plain(c), "[^a-z0-9]", "")
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(plain(c), "[^a-z0-9]+"), ""))
    exact = registry.join(files, F.col("expected") == F.col("file")).groupBy("expected").agg(F.max("file").alias("file"), F.lit(1).alias("way"))
    equal = registry.join(files, norm("expected") == norm("file")).groupBy("expected").agg(F.max("file").alias("file"), F.count("*").alias("n"))
    asked = registry.select("expected", F.size(tokens("expected")).alias("size"), F.explode(tokens("expected")).alias("t"))
    held = asked.join(files.select("file", F.explode(tokens("file")).alias("t")), "t").groupBy("expected", "size", "file").agg(F.countDistinct("t").alias("c"))
    held = held.where("c = size").groupBy("expected").agg(F.max("file").alias("file"), F.count("*").alias("n"))
    every = exact
    for way, found in ((2, equal), (3, held)):
        every = every.unionByName(found.where("n = 1").select("expected", "file", F.lit(way).alias("way")))
    return registry.select("expected").join(every.groupBy("expected").agg(F.min_by("file", "way").alias("file")), "expected", "left")


def ocr_words_to_pages(words: DataFrame, least: float = 40) -> DataFrame:
    """Words (page, block, par, line, i, conf, word) to `(page, text, confidence)`: sure words in order, a line each."""
    good = words.where((F.col("conf") >= least) & (F.trim("word") != ""))
    line = good.groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("t"), F.sum("conf").alias("s"), F.count("*").alias("n"))
    page = line.groupBy("page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"), F.round(F.sum("s") / F.sum("n") / 100, 3).alias("confidence"))
    every = words.select("page").distinct()
    return every.join(page, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def page_documents(pages: DataFrame, max_pages: int | None = None, first_skip: int = 0) -> DataFrame:
    """Pages (book, part, page, skip array) of several files as one book with running page numbers.

    Pages listed in `skip`, the first `first_skip` and those from max_pages on (per file) are left out."""
    size = pages.groupBy("book", "part").agg((F.max("page") + 1).alias("n"))
    before = size.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("book").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = pages.where(~F.coalesce(F.array_contains("skip", F.col("page")), F.lit(False)) & (F.col("page") >= first_skip))
    if max_pages is not None:
        kept = kept.where(F.col("page") < max_pages)
    return kept.join(before.drop("n"), ["book", "part"]).withColumn("book_page", F.col("page") + F.col("offset")).drop("offset")
