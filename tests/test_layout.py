"""Substring index, stored index, distributed places and scans, phrase automaton, stateful streams: against plain versions."""
import datetime
import glob
import os
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hooks, translit
from corpusloom.operators import almanac, index, ivf, pages, phrases, ranks, search, store, usage, vectors, verify
from corpusloom.plans import registry
from corpusloom.profiles import DEVANAGARI, LATIN
from corpusloom.session import Scratch, ensure_checkpoint_dir
from corpusloom.streaming import ingest, policy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged_folders(spark):
    ensure_checkpoint_dir(spark)
    return set(glob.glob(urllib.parse.urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path + "/staged-*"))


@pytest.mark.parametrize("p", [LATIN, DEVANAGARI])
def test_words_that_contain_a_term(spark, p):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    terms = sorted({w[rng.randint(0, 3) :][: rng.randint(1, 5)] for w in words} | {"zzz", "abcz", "aaaa"})
    terms = [t for t in terms if len(t) >= p.least_term]
    grams = search.word_grams(spark.createDataFrame([(w,) for w in words], "word string"), p.least_term)
    found = search.containing(spark.createDataFrame([(t,) for t in terms], "term string"), grams)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(t, w) for t in terms for w in words if t in w}


@pytest.mark.parametrize("name", ["q04_keyword_search", "w02_cross_book_search", "q08_global_search"])
def test_search_reads_the_store_without_pairs(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Bucketed: true" in text


def documents(spark, ids, version=""):
    rng = random.Random(7)
    words = ["sun", "moon", "river", "stone", "flower", "sunflower", "moonstone", "the"]
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + (version if i % 3 == 0 else "")
        if i in ids:
            rows.append((f"c{i:03}", f"b{i % 4}", "Title", "en", i, i // 10, "head", None, 5, text))
    return spark.createDataFrame(rows, "id string, book string, book_title string, language string, page int, chapter int, chapter_title string, section int, word_count int, text string")


def test_a_merged_store_is_a_built_one(spark, tmp_path):
    built, merged = (store.Store(spark, str(tmp_path / x), LATIN, 10) for x in ("built", "merged"))
    built.build(documents(spark, range(80), " meadow"))
    merged.build(documents(spark, range(50)))
    merged.merge(documents(spark, range(30, 80)))
    for _ in range(2):  # the second time changes nothing
        merged.merge(documents(spark, range(80), " meadow"))
        for name in (*store.BUCKETED, *store.PLAIN):
            assert sorted(map(str, merged.table(name).collect())) == sorted(map(str, built.table(name).collect())), name
    want = index.build_postings(documents(spark, range(80), " meadow"), LATIN, 10)
    assert sorted(map(tuple, merged.table("postings").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(merged.versions()) == 2
    joined = spark.createDataFrame([("sun",)], "word string").hint("merge").join(merged.table("postings"), "word")
    assert plan(joined).count("Exchange hashpartitioning") == 1  # the asked words alone
    built.close()
    merged.close()


def test_a_failed_merge_leaves_the_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"), LATIN)
    kept.build(documents(spark, range(20)))
    before = kept.table("terms").count()
    bad = documents(spark, range(20, 40)).withColumn("text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        kept.merge(bad)
    assert kept.versions() == [1] and kept.table("terms").count() == before and not os.path.exists(tmp_path / "s/v2")
    kept.close()


def test_places_in_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 40), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "book string, page int, id int").repartition(6)
    want, last = {}, {}
    for b, p, i in sorted(rows, key=lambda r: (r[0] is not None, r)):
        want[i] = last[b] = last.get(b, -1) + 1
    with Scratch(spark) as scratch:
        got = ranks.places(frame, "book", "page", "id", scratch=scratch)
        assert "Window" not in plan(got).replace("Window [sum(n", "")
        found = got.collect()
        assert {r.id: r.i for r in found} == want and sorted(r.row for r in found) == list(range(3000))
        assert all(r.c == last[r.book] + 1 for r in found)
        # the hot group lies in several ranges
        assert len(glob.glob(urllib.parse.urlparse(next(iter(scratch.paths.values()))[1]).path + "/part-*.parquet")) > 2
        none = ranks.places(frame.limit(0), "book", "page", "id", scratch=scratch)
        assert none.count() == 0


def plain_structure(rows, mode):
    state, out, book = (None,) * 4, {}, object()
    for b, page, line, kind, num, text in sorted(rows):
        if b != book:
            book, state = b, (None,) * 4
        c, t, s, v = state
        if mode == "strict":
            state = (num if kind in ("C", "S") and num is not None else c, None, None, None)
        elif kind == "C":
            state = (num if num is not None else (c or 0) + 1, text[:120], None, None)
        elif kind == "S":
            state = (c, t, num if num is not None else (s or 0) + 1, None)
        elif kind == "V":
            state = (c, t, s, (v or 0) + 1)
        out[b, page, line] = state
    return out


@pytest.mark.parametrize("mode", ["increment", "strict"])
def test_structure_of_a_hot_book_equals_the_loop(spark, mode):
    rng = random.Random(3)
    rows = []
    for page in range(700):
        for line in range(rng.randint(0, 5)):
            kind = rng.choice(["C", "S", "V", "V", None, None, None] if rng.random() < 0.4 else [None, "V"])
            rows.append(("hot" if page < 600 else f"b{page % 9}", page, line, kind, rng.choice([None, page]) if kind in ("C", "S") else None, f"text {page} {line}"))
    frame = spark.createDataFrame(rows, "book string, page int, line int, kind string, num int, text string").repartition(5)
    got = {(r.book, r.page, r.line): (r.chapter, *((r.chapter_title, r.section, r.verse) if mode == "increment" else (None,) * 3)) for r in pages.running_structure(frame, mode).collect()}
    assert got == plain_structure(rows, mode)
    with Scratch(spark) as scratch:
        assert "Window" not in plan(pages.running_structure(frame, mode, scratch))


def test_neighbours_and_samples_use_no_window_over_books(spark, sf):
    for name in ("w07_chunk_positions", "t05_even_sample", "t06_middle_sample", "t09_daily_pick", "u03_trigram_jaccard", "j11_book_overview"):
        registry.queries()[name](spark, sf).count()
    rows = [("a" if i < 50 else "b", i, i, "x" * 50 if i % 10 else "short") for i in range(60)]
    chunks = spark.createDataFrame(rows, "book string, page int, id int, text string")
    kept = spark.createDataFrame([(1, 5, "a", 0.9, 1), (1, 49, "a", 0.8, 2), (1, 11, "a", 0.7, 3), (1, 20, "a", 0.6, 4), (2, 50, "b", 0.5, 1)], "query_id int, id int, book string, score double, rank int")
    got = {(r.query_id, r.id): (r["rank"], r.offset) for r in search.add_neighbours(kept, chunks).collect() if r.match_type == "neighbour"}
    # 10 and 50 are short, 49 is the last of its book
    assert got == {(1, 4): (1, 1), (1, 6): (1, 2), (1, 48): (2, 1), (1, 12): (3, 2), (2, 51): (1, 2)}


def test_samples_of_books_without_long_chunks(spark):
    rows = [("long", i, i, "x" * 500) for i in range(20)] + [("none", i, 100 + i, "y" * (i + 1)) for i in range(20)]
    chunks = spark.createDataFrame(rows, "book string, page int, id int, text string")
    got = sorted(r.id for r in pages.even_sample(chunks, 4).collect())
    assert got == [0, 5, 10, 15, *range(112, 120)]
    day = F.lit("2024-03-15").cast("date")
    assert [r.id for r in pages.daily_pick(chunks, day, "dayofmonth").collect()] == [15]


@pytest.mark.parametrize("shard", [4_000_000, 20])
def test_phrases_equal_contains(spark, shard):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None]
    listed = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)}) + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame([(p,) for p in listed], "p string")
    found = phrases.containing_phrases(frame, F.col("t"), table, "p", shard)
    assert "NestedLoop" not in plan(found)
    assert sorted((r.id, r.phrase) for r in found.collect()) == sorted((i, p) for i, t in enumerate(texts) if t for p in listed if p and p in t)
    assert phrases.containing_phrases(frame, F.col("t"), table.limit(0), "p").count() == 0


def test_names_meet_lines_by_the_automaton(spark):
    answers = spark.createDataFrame([(1, "Blue Book states that all is well.\nplain — Red Book"), (2, "Red Book says that no.\nend — Blue Book")], "id int, text string")
    evidence = spark.createDataFrame([(1, "blue", "all is well"), (2, "blue", "no")], "id int, book string, text string")
    names = spark.createDataFrame([("Blue Book", "blue"), ("Red Book", "red"), ("Red", "red")], "name string, book string")
    found = verify.verify_answers(answers, evidence, names)
    assert "NestedLoop" not in plan(found)
    got = {r.id: (r.text, r.citations) for r in found.collect()}
    assert got == {1: ("Blue Book states that all is well.\nplain", 1), 2: ("no.\nend — Blue Book", 1)}


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


EVENT = "event_id long, identity long, feature string, ts timestamp"


def _put(spark, folder, n, rows):
    made = spark.createDataFrame(rows, EVENT).coalesce(1)
    made.write.parquet(f"{folder}-{n}")
    (part,) = glob.glob(f"{folder}-{n}/part-*.parquet")
    os.makedirs(folder, exist_ok=True)
    os.rename(part, f"{folder}/{n}.parquet")
    os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(policy.STORE)
    policy.use_rocksdb(spark)
    yield
    spark.conf.set(policy.STORE, before)


def test_daily_quota_with_late_rows(spark, tmp_path, rocksdb):
    day = datetime.datetime(2024, 5, 1, 6)
    rng = random.Random(2)
    batches = [[(b * 100 + i, rng.randint(0, 2), "ask", day + datetime.timedelta(days=b, seconds=rng.randint(0, 9999))) for i in range(12)] for b in range(3)]
    batches[2] += [(900 + i, 1, "ask", day + datetime.timedelta(seconds=i)) for i in range(8)]  # two days late
    want, used = {}, {}
    for n, rows in enumerate(batches):
        _put(spark, str(tmp_path / "in"), n, rows)
        for i, who, _, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            key = who, (ts + datetime.timedelta(minutes=330)).date()
            ok = who == 0 or used.get(key, 0) < 3
            used[key] = used.get(key, 0) + (ok and who != 0)
            want[i] = (ok, None if who == 0 else max(0, 3 - used[key]))
    decided = policy.daily_quota_stream(_stream(spark, str(tmp_path / "in"), EVENT), F.lit(3), exempt=F.col("identity") == 0)
    policy.drain(decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start(), 120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id: (r.allowed, r.remaining) for r in got} == want and len(got) == len(want)


def test_fixed_window_stream_equals_the_batch(spark, tmp_path, rocksdb):
    rng, start, at, rows = random.Random(5), datetime.datetime(2024, 5, 1), {}, []
    for i in range(120):
        who = rng.randint(0, 3)
        at[who] = at.get(who, 0) + rng.choice([1, 2, 5, 30, 61, 200])
        rows.append((i, who, "x", start + datetime.timedelta(seconds=at[who])))
    for n, low in enumerate(range(0, 120, 40)):
        _put(spark, str(tmp_path / "in"), n, rows[low : low + 40])
    limited = policy.fixed_rate_limit_stream(_stream(spark, str(tmp_path / "in"), EVENT), "identity", limit=3, ttl=60, late="2 hours")
    policy.drain(limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start(), 120)
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = usage.rate_limit(spark.createDataFrame(rows, EVENT), "identity", limit=3, ttl=60, mode="fixed")
    assert got == {r.event_id: r.accepted for r in batch.collect()} and len(set(got.values())) == 2


def test_ingestion_survives_a_crash_and_a_replay(spark, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = datetime.datetime(2024, 5, 1)
    _put(spark, folder, 0, [(i, 1, "old", now) for i in range(10)])
    _put(spark, folder, 1, [(i, 2, "new", now) for i in range(5, 15)] + [(5, 2, "new", now)])
    stream = _stream(spark, folder, EVENT)
    write = ingest._write

    def crash(rows, path, batch):
        write(rows, path, batch)
        if batch == 1 and not os.path.exists(tmp_path / "crashed"):
            open(tmp_path / "crashed", "w").close()
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(ingest, "_write", crash)
    with pytest.raises(Exception, match="lost after the write"):
        ingest.ingest(stream, out, str(tmp_path / "cp"), key="event_id").awaitTermination()
    for _ in range(2):  # the retry, and one with nothing new
        ingest.ingest(stream, out, str(tmp_path / "cp"), key="event_id").awaitTermination()
    want = sorted((i, 1 if i < 5 else 2) for i in range(15))
    assert sorted((r.event_id, r.identity) for r in ingest.current(spark, out, "event_id").collect()) == want
    assert sorted(os.listdir(out)) == ["batch=0", "batch=1"] and spark.read.parquet(out).count() == 20
    ingest.compact(spark, out, str(tmp_path / "compact"), "event_id")
    assert sorted((r.event_id, r.identity) for r in ingest.current(spark, str(tmp_path / "compact"), "event_id").collect()) == want


def test_nothing_staged_is_left(spark, sf):
    before = staged_folders(spark)
    for name in ("u03_trigram_jaccard", "w06_structure", "w07_chunk_positions", "j08_neighbours", "t05_even_sample", "q02_build_chunks"):
        registry.queries()[name](spark, sf).count()
    with pytest.raises(Exception, match="broken"), Scratch(spark) as scratch:
        scratch.staged(spark.range(5))
        scratch.bucketed(spark.range(5), "id")
        scratch.staged(spark.range(5).withColumn("x", F.raise_error(F.lit("broken"))))
    assert staged_folders(spark) == before and not [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]


@pytest.mark.parametrize("clustered", [True, False])
def test_inverted_lists_find_what_brute_force_finds(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) + (8 * rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] if clustered else 0)
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, v array<double>").repartition(5)
    centroids = ivf.fit_lists(frame, sample=1000)
    held = ivf.index_vectors(frame, centroids).cache()
    assert held.count() == 3000 and held.select("id").distinct().count() == 3000
    asked = frame.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    probe = ivf.probes_for(held, centroids, 10)
    found = ivf.semantic_topk(asked, held, centroids, 10, probe=probe).cache()
    exact = vectors.vector_topk(asked, frame, 10)
    assert ivf.recall(found, exact).first()[0] >= 0.9 and (probe < len(centroids) / 5 if clustered else probe <= len(centroids))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r.score - unit[r.query_id] @ unit[r.id]) < 1e-8 for r in found.collect())
    every = ivf.semantic_topk(asked, held, centroids, 10, probe=len(centroids), rescore=300)
    assert {(r.query_id, r.id) for r in every.collect()} == {(r.query_id, r.id) for r in exact.collect()}
    assert ivf.semantic_topk(asked, held.limit(0), centroids, 10, probe=2).collect() == []


def test_names_of_lunar_days(spark):
    rows = [(0, "shukla", 0), (14, "shukla", 28), (15, "krishna", 5), (29, "krishna", None), (13, "shukla", 29)]
    got = almanac.almanac_names(spark.createDataFrame(rows, "tithi int, paksha string, muhurta int"), "en").collect()
    assert [(r.tithi_name, r.muhurta_name) for r in got] == [
        ("Pratipada", "Muhurta 1"), ("Purnima", "Brahma Muhurta"), ("Pratipada", "Muhurta 6"), ("Amavasya", "—"), ("Chaturdashi", "Muhurta 30")
    ]
    (hindi,) = almanac.almanac_names(spark.createDataFrame(rows[:1], "tithi int, paksha string, muhurta int"), "hi").collect()
    assert (hindi.tithi_name, hindi.muhurta_name) == ("प्रतिपदा", "मुहूर्त 1")


def test_a_model_that_is_away_gives_no_scores(spark):
    def away(q, t):
        raise RuntimeError("down")

    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query string, text string").coalesce(1)
    assert [r["rerank"] for r in hooks.rerank(pairs, away, batch=2).collect()] == [None] * 3


def test_daily_quota_calls_python_once_an_identity(spark, tmp_path, rocksdb):
    """A call for each identity of a trigger, not for each feature and day; and a trigger may outlast any fixed time."""
    calls, start = spark.sparkContext.accumulator(0), datetime.datetime(2024, 5, 1)
    own = policy._rows

    def counted(frames):
        calls.add(1)
        return own(frames)

    rows = [(i, i % 2, f"f{i // 2 % 3}", start + datetime.timedelta(days=i // 6 % 4, seconds=i)) for i in range(240)]
    for n in range(2):  # the second trigger goes on from the state of the first
        _put(spark, str(tmp_path / "in"), n, rows[n * 120 : n * 120 + 120])
    policy._rows = counted
    try:
        decided = policy.daily_quota_stream(_stream(spark, str(tmp_path / "in"), EVENT), F.lit(7))
        policy.drain(decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start())
    finally:
        policy._rows = own
    got = {r.event_id: (r.day, r.allowed, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = usage.quota_decisions(spark.createDataFrame(rows, EVENT), F.lit(7)).collect()
    assert got == {r.event_id: (r.day, r.allowed, r.remaining) for r in batch}
    assert calls.value == 4 and policy.drain.__defaults__ == (float("inf"),)


def test_term_frequencies_are_counted_in_the_row(spark):
    """No shuffle and no aggregate where ids are unique; repeated ids are summed."""
    rows = [(1, "Alpha beta alpha the beta-alpha"), (2, "the of"), (3, None), (4, ""), (5, "gamma"), (6, "x alpha\nGamma")]
    unique = index.term_frequencies(spark.createDataFrame(rows, "id long, text string"), LATIN)
    want = {(1, "alpha"): 3, (1, "beta"): 2, (5, "gamma"): 1, (6, "alpha"): 1, (6, "gamma"): 1}
    assert {(r.id, r.word): r.tf for r in unique.collect()} == want and unique.count() == len(want)
    assert "Exchange" not in plan(unique) and "Aggregate" not in plan(unique) and dict(unique.dtypes)["tf"] == "bigint"
    twice = index.term_frequencies(spark.createDataFrame([*rows, (1, "alpha delta")], "id long, text string"), LATIN)
    assert {(r.id, r.word): r.tf for r in twice.collect()} == want | {(1, "alpha"): 4, (1, "delta"): 1} and twice.count() == len(want) + 1


def test_asked_postings_are_those_that_a_search_needs(spark):
    """Words that equal a term, and of the terms that are no word those that hold it; nothing of other words leaves the scan."""
    rows = [(i, f"alpha beta{i} alphabet {'alpha ' * (i % 3)}gamma tabetan the") for i in range(12)] + [(12, None), (13, "")]
    chunks = spark.createDataFrame(rows, "id long, text string").withColumns({"book": F.lit("b")})
    asked = spark.createDataFrame([(1, "Alpha bet the nothing"), (2, "gamma alpha")], "query_id int, query string")
    every = index.build_postings(chunks, LATIN, 5)
    with Scratch(spark) as scratch:
        got = index.asked_postings(chunks, search.asked_terms(asked, LATIN), LATIN, scratch, 5)
        want = {tuple(r) for r in every.collect() if r.word in ("alpha", "gamma") or "bet" in r.word}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
        whole = index.asked_postings(chunks, search.asked_terms(asked, LATIN), LATIN, scratch, 5, most=1)
        assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in every.collect()}
        a, b = (search.keyword_scores(asked, x, chunks, LATIN, least_words=1).orderBy("query_id", "id").collect() for x in (got, every))
        assert a == b and a


def test_homoglyphs_are_turned_in_few_passes(spark):
    """Letters that become one letter or none share a pass; results are those of a replacement for each letter."""
    texts = ["".join(translit.CYRILLIC) + " " + translit.CYRILLIC.upper() + x for x in (" plain latin text, long enough", " अबकखगघङचछजझञटठडढणतथदधनपफबभमयरलव" * 3)]
    fixed, n = translit.repair_homoglyphs("t")
    df = spark.createDataFrame([(t,) for t in [*texts, "as it is", "", None]], "t string").select("t", fixed.alias("f"), n.alias("n"))

    def turned(text, table):
        for letter, new in table.items():
            text = text.replace(letter, new).replace(letter.upper(), new)
        return text

    want = [(turned(texts[0], translit.TO_LATIN), 1), (turned(texts[1], translit.TO_DEVANAGARI), 1), ("as it is", 0), ("", 0), (None, 0)]
    letters = len(translit.CYRILLIC) * 2
    assert [(r.f, r.n) for r in df.collect()] == [(t, letters if k else 0) for t, k in want]
    assert plan(df).count("replace(") < 40
