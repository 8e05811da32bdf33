"""Substring dedup, lexical search and importance resampling against plain versions, and on awkward rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import importance, lexical_search, lexical_sql, line_dedup, substring_dedup
from corpusloom.llm.keys import texts
from corpusloom.session import Scratch

SCHEMA = "doc_id long, text string"


def plain_substrings(docs, depth):
    """docs in order of (id); {id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - depth + 1):
            s = data[j : j + depth]
            if s in seen:
                gone[j : j + depth] = b"\1" * depth
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def copied_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))
        if kind < 0.3:
            text += rng.choice(passages)[rng.randint(0, 30) :] + text[: rng.randint(0, 50)]
        elif kind < 0.5 and docs:
            text = docs[rng.randrange(len(docs))][1]
            at = rng.randint(0, max(0, len(text) - 1))
            text = text[:at] + rng.choice("xyzü") + text[at + 1 :]
        elif kind < 0.6:
            text = rng.choice("ab") * rng.randint(0, 700) + rng.choice(passages)
        elif kind < 0.65:
            text = "abc" * rng.randint(0, 200)
        docs.append((rng.randint(-5, 10_000_000) if i % 7 else i, text))
    return list({i: (i, t) for i, t in docs}.values())


@pytest.mark.parametrize("depth,large,seed", [(100, 4096, 1), (100, 1, 2), (40, 4096, 3), (40, 2, 4)])
def test_substrings_equal_the_plain_version(spark, depth, large, seed):
    docs = copied_texts(150, seed)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.substring_report(frame, depth=depth, large=large).collect()}
    assert got == plain_substrings(docs, depth)


def test_substrings_in_pieces(spark, monkeypatch):
    docs = copied_texts(60, 9)
    powers, found = substring_dedup.Powers(), {}
    for piece in (1 << 21, 300):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([0] * len(docs)), pa.array([d[1] for d in docs])], ["k", "x", "text"])
        starts = set()
        for keys, _, offsets, raw, bounds in substring_dedup._pieces(batch, 100):
            doc, place, n, _, _ = substring_dedup.phrases(raw, bounds, 100, powers)
            starts |= {(keys[d], offsets[d] + p + j) for d, p, m in zip(doc, place, n) for j in range(m)}
        found[piece] = starts
    assert found[1 << 21] == found[300] == {(i, j) for i, t in docs for j in range(len(t.encode()) - 99)}


def test_substrings_of_awkward_rows(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "short", 0), (5, long, 0), (5, long, 0), (6, long[1000:2000], 0), (7, long, 0), (None, long + "!", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans long").withColumnRenamed("spans", "x")
    got = sorted(substring_dedup.substring_report(frame).collect(), key=lambda r: (r[0] is None, r[0]))
    assert [(r.doc_id, r.n_bytes) for r in got] == [(1, 0), (2, 0), (3, 5), (4, 5), (5, 5000), (5, 5000), (6, 1000), (7, 5000), (None, 5001)]
    # a null id is a hash, which may come before or after
    assert got[0].n_removed == got[2].n_removed == 0 and got[6].n_removed == 1000 and got[7].n_removed == 5000
    assert got[4] == got[5] and {got[4].n_removed, got[8].n_removed} in ({0, 5000}, {5000, 0})
    empty = substring_dedup.substring_report(frame.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    with Scratch(spark) as scratch:
        texts = {r.doc_id: r.text for r in substring_dedup.drop_repeated_substrings(frame.where("doc_id < 7"), scratch=scratch).collect()}
    assert texts[5] == long and texts[6] == "" and texts[3] == "short"


def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k):
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = Counter(t for _, x in held for t in set(x))
    out = []
    for item, text in items:
        found = []
        for i, t in held:
            tf, m = Counter(t), 75 + (25 * len(t) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in plain_terms(text) if x in tf
            )
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_words", [20_000, 30])
def test_search_equals_the_plain_version(spark, block_words):
    rng = random.Random(3)
    words = ["Ab", "ab", "éa", "Éa", "x1", "日本", "c", "dd", "ee", "ff", "g", "h9"]
    docs = [(i, "-".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(25)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(6)
    got = lexical_search.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(docs, items, 20)


def test_search_sql(spark):
    docs = [(i, t) for i, t in copied_texts(200, 12)]
    items = [(i, t[:200]) for i, t in docs[::20]]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = lexical_search.rank_documents(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == sorted(con.execute(lexical_sql.SQL).fetchall())


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3_000_000, (7, 9000)) * (rng.random((7, 9000)) < 0.2)
    w[3, 5] = 10**10  # alone beyond the bound of a tile
    x = rng.integers(0, 10**6, (9000, 11))
    want = [[sum(int(a) * int(b) for a, b in zip(row, col) if a) for col in x.T] for row in w]
    assert len(lexical_search.term_tiles(w.max(axis=0))) > 2
    assert lexical_search.tile_scores(w, x).tolist() == want


def test_search_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "...", "x"), (5, "cat dog", "x"), (4, "cat dog", "x"), (4, "cat dog", "x"), (None, "cat dog", "x"), (9, "eel " * 50_000, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "CAT"), (7, "CAT"), (8, None), (9, "?"), (None, "dog dog")], "item_id long, text string")
    got = sorted(((r.item_id or 0, r["rank"], r.doc_id) for r in lexical_search.rank_documents(docs, items).collect()))
    assert got == [(0, 1, 4), (0, 2, 4), (0, 3, 5), (0, 4, None), (7, 1, 4), (7, 2, 4), (7, 3, 5), (7, 4, None)]
    assert lexical_search.rank_documents(docs.limit(0), items).collect() == []
    assert lexical_search.rank_documents(docs, items.limit(0)).collect() == []


def plain_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(plain_features(x)[1])
    for x in target:
        t.update(plain_features(x)[1])
    total, wanted, rows = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        words, found = plain_features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    long = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: n + 1 for n, r in enumerate(long[: percent * len(long) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def test_resampling_equals_the_plain_version(spark):
    rng = random.Random(8)
    words = ["The", "of", "é", "日本語", "x" * 300, "a1", "B2", "under_score", "don't"]
    docs = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(5000, None), (5001, ""), (5002, "!!")]
    target = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(7)
    got = importance.importance_resample(frame, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"))
    want = plain_resample(docs, target)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(r[4] for r in want if r[4]) == list(range(1, max(r[4] for r in want if r[4]) + 1))


def test_shifted_crcs_are_those_of_substrings():
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "bc" * 40, "d" * 5000, "éé"]) for _ in range(200))
    before, behind, start, end = importance.running_crcs(text)
    data = text.encode()
    for i in range(0, 190):
        for j in (i, i + 2, i + 9):
            got = behind[j : j + 1] ^ importance.shift(before[i : i + 1], np.array([end[j] - start[i]]))
            assert int(got[0]) == zlib.crc32(data[start[i] : end[j]])


def test_resampling_of_awkward_rows(spark):
    frame = spark.createDataFrame([(1, "a b " * 40, 1), (1, "a b " * 40, 1), (None, "c " * 30, 1), (2, "word " * 40_000, 1), (3, None, 1)], "doc_id long, text string, rank int")
    none = spark.createDataFrame([], "item_id long, text string")
    got = importance.importance_resample(frame, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 5
    assert {r.n_features for r in got if r.doc_id == 2} == {119_997} and [r.weight for r in got if r.doc_id == 3] == [0]
    assert importance.importance_resample(frame.limit(0), none).collect() == []


def test_run_gives_the_rows_of_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in corpus_pipeline.STAGES:
            docs = scratch.staged(stage(spark, docs, sf))
        want = sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == want != []
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    assert all(b == 0 if x != y else b == a + n for (x, a, n), (y, b, _) in zip(spans, spans[1:]))


def test_hot_words_meet_in_pairs(spark, monkeypatch):
    """Lines over few words, one of them in half of all lines: results as in plain Python, no key as large as before."""
    monkeypatch.setattr(line_dedup, "HOT", 16)
    pick = random.Random(5)
    words = [f"w{i}" for i in range(24)]
    docs, seen, want = [], [], {}
    for i in range(60):
        lines = []
        for j in range(12):
            line = pick.sample(words, pick.choice((1, 4, 5, 6, 8, 12))) + ["common"] * pick.randint(0, 1)
            s = set(line)
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want.setdefault(i, []).append(j)
            seen.append(s)
            lines.append(" ".join(line))
        docs.append((i, "\n".join(lines)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",")] for r in line_dedup.line_report(d, least=1).collect() if r["removed"]}
    assert got == want
    found = line_dedup.prefixes(line_dedup.line_sets(texts(d), 1), 80).cache()
    largest = lambda rows: rows.groupBy("x").count().agg({"count": "max"}).first()[0]
    hot = line_dedup.hot_words(found)
    single = line_dedup.postings(found, hot.where("false"), 80)
    assert hot.count() > 0 and 2 * largest(line_dedup.postings(found, hot, 80)) < largest(single)


def test_hot_words_of_sets_that_one_word_links(spark, monkeypatch):
    """At 50 percent one common word links two short lines: they meet at it even if it is hot."""
    monkeypatch.setattr(line_dedup, "HOT", 2)
    docs = [(0, "a"), (1, "a b"), (2, "a c d"), (3, "a e f g"), (4, "a b c d e"), (5, "x a"), (6, "y a z q"), (7, "y z a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [set(t.split()) for _, t in docs]
    want = {i for i in range(8) if any(2 * len(sets[i] & o) >= len(sets[i] | o) for o in sets[:i])}
    got = {r["doc_id"] for r in line_dedup.line_report(d, least=1, percent=50).collect() if r["removed"]}
    assert got == want


def test_hot_words_are_looked_up_without_a_shuffle(spark):
    """The few hot words go to the sets: otherwise each set is shuffled with its prefix for each of its prefix words."""
    found = spark.createDataFrame([], "h long, n int, p long, q long, prefix array<long>, next long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posted = line_dedup.postings(found, spark.createDataFrame([(1, True)], "x long, hot boolean"), 80)
        assert "SortMergeJoin" not in posted._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_postings_are_shuffled_once(spark):
    """Both sides of the semi-join are one shuffle: none goes through a union and is shuffled again for each part of it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(h, 6, h, 0, [10, 20 + h % 2, 30 + h], None if h % 2 else 99) for h in range(40)]
    found = spark.createDataFrame(rows, "h long, n int, p long, q long, prefix array<long>, next long")
    try:
        posted = line_dedup.postings(found, spark.createDataFrame([(20, True)], "x long, hot boolean"), 80)
        # a hot word is posted with each of the two words after it
        assert posted.count() == 20 * 3 + 20 * 4
        a, b = (posted.alias(side) for side in "ab")
        met = a.join(b.hint("merge"), line_dedup.F.expr(line_dedup._near(80)), "left_semi")
        plan = lambda: met._jdf.queryExecution().executedPlan().toString()
        assert plan().count("SortMergeJoin") == 1
        met.collect()
        assert "ReusedExchange" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
