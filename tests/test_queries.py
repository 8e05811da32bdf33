"""Registered queries against their DuckDB twins, and the operators that no table stands in for."""
import datetime
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, hooks, text, translit
from corpusloom.operators import almanac, index, pages, usage, verify
from corpusloom.plans import registry
from corpusloom.profiles import DEVANAGARI, LATIN
from corpusloom.sources import files
from corpusloom.streaming import usage as stream

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    def flat(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (pd.Timestamp, datetime.date)):
            return str(x)[:10]
        if hasattr(x, "item") and not hasattr(x, "__len__"):
            x = x.item()
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(map(flat, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["p05_real_word_gate", "f05_chunk_pages", "a05_postings", "q04_keyword_search", "q08_global_search", "w09_quota_decisions", "w13_repeat_lines", "j09_quote_grounded", "c06_almanac", "u03_trigram_jaccard"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert cells(registry.queries()[name](spark, sf).toPandas()) == cells(con.sql(registry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_chunks_stay_within_bounds(spark):
    long = "x" * 700 + ". " + "y" * 900 + ". " + "z" * 100
    (got,) = one(spark, "short\n\n" + long + "\n\n" + "w" * 79, chunking.chunk_text("t"))
    assert all(80 <= len(x) <= 1500 for x in got) and len(got) == 2
    assert one(spark, "v" * 3000, chunking.chunk_text("t"))[0] == ["v" * 3000]
    assert one(spark, "", chunking.chunk_text("t"))[0] == [] and one(spark, "u" * 1500, chunking.chunk_text("t"))[0] == ["u" * 1500]
    (got,) = one(spark, "\n\n".join(c * 1000 for c in "abc"), chunking.chunk_overlap("t"))
    assert got[1].startswith("a" * 200 + "\n\n" + "b" * 10)


def test_garble_gate_and_sentences(spark):
    assert one(spark, "द च सत नि धा धत जी थी कह नल से शु कणा", text.looks_garbled("t", DEVANAGARI))[0]
    assert not one(spark, "धर्म और सत्य के मार्ग पर चलना ही मनुष्य का सबसे बड़ा कर्तव्य माना गया है", text.looks_garbled("t", DEVANAGARI))[0]
    assert one(spark, "सत्य बोलना चाहिए।", text.has_sentences("t", DEVANAGARI))[0] and not one(spark, "| १ | २ |", text.has_sentences("t", DEVANAGARI))[0]


def test_query_language_and_transliteration(spark):
    for t, want in (("मृत्यु के बाद", "hi"), ("What happens to the soul after death?", "en"), ("mera job chhut gaya hai", "mixed"), ("12 ?", "unknown")):
        assert one(spark, t, text.query_language("t", DEVANAGARI))[0] == want
    assert one(spark, "धर्म", translit.romanise("t"))[0] == "dharm"
    assert [one(spark, w, translit.fuzzy_key("t"))[0] for w in ("gyan", "jnan", "kitaab", "kitab", "mantron", "mantra")] == ["jnan", "jnan", "kitab", "kitab", "mantr", "mantr"]
    words = spark.createDataFrame([("hai", "है"), ("ka", "का")], "word string, native string")
    lexicon = spark.createDataFrame([("dharm", "धर्म")], "key string, native string")
    d = spark.createDataFrame([(1, "dharma ka job hai?"), (2, "plain English here")], "id int, t string")
    got = {r["id"]: (r["query"], r["transliterated"]) for r in translit.transliterate(d, "t", words, lexicon).collect()}
    assert got == {1: ("धर्म का job है?", True), 2: ("plain English here", False)}
    fixed = translit.repair_homoglyphs("t")
    assert one(spark, "एक нарам सवाल पूछना चाहता हूं", *fixed) == ("एक नरम सवाल पूछना चाहता हूं", 5)


def test_structure_runs_over_pages(spark):
    p = spark.createDataFrame([("b", 1, "chapter 3\nsection 2\n॥ 1 ॥\n॥ 2 ॥"), ("b", 2, "text\nkanda bala\nsection 9"), ("b", 3, "plain")], "book string, page int, text string")
    got = {r["page"]: (r["chapter"], r["section"], r["verse"]) for r in pages.page_structure(p).collect()}
    assert got == {1: (3, 2, 2), 2: (4, 9, None), 3: (4, 9, None)}


def test_duplicates_compare_with_the_last_accepted_page(spark):
    base = [f"w{i}" for i in range(120)]
    a, b, c = " ".join(base), " ".join([*base[:114], *[f"x{i}" for i in range(6)]]), " ".join([*base[:108], *[f"y{i}" for i in range(12)]])
    p = spark.createDataFrame([("b", 1, a, True), ("b", 2, b, True), ("b", 3, c, True)], "book string, page int, text string, usable boolean")
    assert [r["duplicate"] for r in pages.flag_duplicate_pages(p).orderBy("page").collect()] == [False, True, False]
    assert [r["duplicate"] for r in pages.flag_duplicate_pages(p, mode="previous").orderBy("page").collect()][:2] == [False, True]


def test_files_resolve_once(spark):
    registry_ = spark.createDataFrame([("VISHNU_1.pdf",), ("gita.pdf",), ("none.pdf",), ("Two.pdf",)], "expected string")
    names = spark.createDataFrame([("VISHNU PURAN 1.pdf",), ("gita.pdf",), ("two a.pdf",), ("two b.pdf",)], "file string")
    assert {r["expected"]: r["file"] for r in pages.resolve_files(registry_, names).collect()} == {"VISHNU_1.pdf": "VISHNU PURAN 1.pdf", "gita.pdf": "gita.pdf", "none.pdf": None, "Two.pdf": None}


def hits(spark, seconds):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("u", i, start + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)], "identity string, event_id bigint, ts timestamp")


def test_rejected_hits_do_not_renew_the_window(spark):
    e = hits(spark, [*range(21), 50, 78, 79])
    got = {r["event_id"]: r["accepted"] for r in usage.rate_limit(e, "identity").collect()}
    assert [i for i in got if not got[i]] == [20, 21, 22] and got[23]


def test_stream_decides_as_the_batch(spark, tmp_path):
    e = hits(spark, [0, 1, 2, 3, 30, 100, 101, 102])
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = stream.start_memory(stream.rate_limit_stream(s, "identity", limit=2), "decided", checkpointLocation=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["accepted"] for r in spark.table("decided").collect()}
    assert got == {r["event_id"]: r["accepted"] for r in usage.rate_limit(e, "identity", limit=2).collect()}


def test_answers_are_verified(spark):
    answers = spark.createDataFrame([(1, "Intro\n“the river flows to the sea forever”\n“an invented line that nobody wrote”\nBook Two says that all is well\ntrue — Book One (p.3)\nfalse — Book Two (p.3)")], "id int, text string")
    evidence = spark.createDataFrame([(1, "one", "Indeed, the river flows to the sea forever.")], "id int, book string, text string")
    names = spark.createDataFrame([("Book One", "one"), ("Book Two", "two")], "name string, book string")
    r = verify.verify_answers(answers, evidence, names).first()
    assert (r["quotes"], r["citations"]) == (1, 2)
    assert r["text"] == "Intro\n“the river flows to the sea forever”\nall is well\ntrue — Book One (p.3)\nfalse"


def test_footer_stops_at_the_last_title(spark):
    rows = [(1, i, t, p) for i, (t, p) in enumerate([("A", 5), ("B", 2), ("A", 3), ("C", 1), ("D", 9), ("A", 1)])]
    assert verify.citations(spark.createDataFrame(rows, "id int, rank int, title string, page int")).first()["footer"] == "A (p.3, p.5) · B (p.2) · C (p.1) · D (p.9)"


def test_almanac_ranges(spark):
    r = almanac.add_almanac(hits(spark, [86400 * d for d in range(0, 400, 7)]), "ts").collect()
    assert all(0 <= x["tithi"] < 30 and 0 <= x["nakshatra"] < 27 and 1 <= x["pada"] <= 4 and 0 <= x["muhurta"] < 30 for x in r)
    assert almanac.add_almanac(hits(spark, [0]), "ts", 85.0, 0.0).first()["muhurta"] is None


def test_pages_and_chunks_round_trip(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "page_0119.json").write_text(json.dumps({"meta": {"book_id": "b", "source_page": 0}, "qa": {"status": "ok"}, "text": "t"}))
    (folder / "page_0120.json").write_text(json.dumps({"book_id": "c", "page": 7, "text": "u", "confidence": 0.5}))
    got = {r["book_id"]: (r["page"], r["page_display"], r["status"]) for r in files.read_pages(spark, str(folder)).collect()}
    assert got == {"b": (119, 120, "ok"), "c": (7, 8, None)}
    store = tmp_path / "books"
    store.mkdir()
    (store / "b.json").write_text(json.dumps({"book": "b", "chunks": [{"id": "ck_1", "book": "b", "text": "words here", "page": 1}, {"id": "ck_2", "book": "b", "text": " "}]}))
    (store / "bad.json").write_text("{not json")
    chunks = files.read_chunks(spark, str(store))
    assert [r["id"] for r in chunks.collect()] == ["ck_1"]
    files.write_store(chunks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    postings = index.build_postings(chunks.select("id", "text"), LATIN)
    files.write_index_shards(postings, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def test_hooks(spark):
    d = spark.createDataFrame([(1, "long enough text to be embedded by the hook, surely"), (2, "short")], "id int, text string")
    got = {r["id"]: r["v"] for r in hooks.embed(d, "text", hooks.hashed_embedder(8), 8).collect()}
    assert len(got[1]) == 8 and got[2] is None

    def failing(q, t):
        if "bad" in t:
            raise RuntimeError
        return [1.0] * len(q)

    pairs = spark.createDataFrame([("q", "good"), ("q", "bad")], "query string, text string").coalesce(1)
    assert [r["rerank"] for r in hooks.rerank(pairs, failing, batch=1).collect()] == [1.0, 0.0]
    assert [r["text"] for r in hooks.rewrite(d, "text", lambda ts: [t.upper() if len(t) > 9 else t * 3 for t in ts]).orderBy("id").collect()][1] == "short"


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_quote_windows_are_found_alike_by_scan_and_join(spark):
    docs = [(1, "Indeed, the river flows to the sea forever."), (2, "nothing of the kind stands here at all, not a word"), (3, None), (4, "short"), (5, "THE RIVER — flows to the sea forever 😀 नदी समुद्र की ओर बहती है सदा के लिए")]
    quotes = [(10, "the river flows to the sea forever"), (11, "नदी समुद्र की ओर बहती है सदा के लिए"), (12, "tiny"), (13, None), (10, "the river flows to the sea forever")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, text string")
    found = lambda most: sorted((r["quote_id"], r["doc_id"]) for r in verify.grounded_windows(q, d, most=most).collect())
    assert found(1_000_000) == found(0) == [(10, 1), (10, 5), (11, 5)]


def test_health_questions_in_either_script(spark):
    rows = [("बुखार का इलाज", True), ("bimari ki dawa", True), ("Sugar level", True), ("sugary tea", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(text.is_health_query("t").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_all_ungrounded_names_of_a_line_go(spark):
    answers = spark.createDataFrame([(1, "Book Two says that Book Four में वर्णित है कि all is well\nfine — BOOK-TWO (p.3)\nboth — Book One, Book Two")], "id int, text string")
    evidence = spark.createDataFrame([(1, "one", "Indeed.")], "id int, book string, text string")
    names = spark.createDataFrame([("Book One", "one"), ("Book Two", "two"), ("Book Four", "four")], "name string, book string")
    r = verify.verify_answers(answers, evidence, names).first()
    assert (r["text"], r["quotes"], r["citations"]) == ("all is well\nfine\nboth — Book One, Book Two", 0, 3)


def test_answer_audit(spark):
    answers = [
        (1, "बुखार का इलाज?", "नарам text\n“an invented line that nobody wrote”\nthis line is long enough to be dropped when it is repeated\nthis line is long enough to be dropped when it is repeated\n\n📚 Aadhaar: made up"),
        (2, "why?", "I couldn't find any direct verse."), (3, "why?", None),
    ]
    a = spark.createDataFrame(answers, "id int, question string, text string")
    evidence = spark.createDataFrame([(1, "one", "Indeed."), (2, "one", "Indeed.")], "id int, book string, text string")
    grounded = spark.createDataFrame([(1, 1, "Book One", 3), (2, 1, "Book One", 4)], "id int, rank int, title string, page int")
    names = spark.createDataFrame([("Book One", "one")], "name string, book string")
    got = {r["id"]: (r["text"], r["quotes"]) for r in verify.answer_audit(a, evidence, names, grounded).collect()}

    assert got[1][0].endswith("\n\n---\n📚 *Aadhaar: Book One (p.3)*\n\n" + verify.NOTE) and "invented" not in got[1][0] and got[1][0].count("long enough") == 1
    assert got[2] == ("I couldn't find any direct verse.", 0)
