"""Steps whose cost grew faster than their input: the same results, and the work done once."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import Row

from corpusloom.functions import chunking, ocr
from corpusloom.operators import index, pages, verify
from corpusloom.profiles import LATIN
from corpusloom.session import Scratch


def test_scan_noise_goes_and_a_word_is_judged_once(spark):
    text = "read xkcd zzzz bcd, this\n\n\n\nसत् कखगघ mixedक १ 12।\u2028\nका के से\nend \u2028"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: (r["a"], r["b"]) for r in d.select("id", ocr.clean_ocr_tokens("t").alias("a"), ocr.clean_display("t").alias("b")).collect()}
    assert got[1] == ("read this\n\nसत् कखगघ १ 12।\u2028\nend \u2028".replace(" \u2028", "\u2028"), "read this\n\nसत् कखगघ १ 12।\u2028\n\nend\u2028")
    assert got[2] == (None, None) and got[3] == ("", "")
    asked = []
    verdicts = ocr._Verdicts(lambda w: not asked.append(w))
    assert all(verdicts[w] for w in "a b a a b".split()) and asked == ["a", "b"]


def test_quotes_are_normalised_once_and_lines_judged_once(spark):
    a = spark.createDataFrame([(1, "He said “a quote that the book does hold, whole and long”.\n“another one that nobody ever wrote down”\nend")], "id long, text string")
    e = spark.createDataFrame([(1, "b", "It has: A QUOTE that the book does hold; whole and LONG!")], "id long, book string, text string")
    out = verify.verify_answers(a, e, spark.createDataFrame([("Title", "b")], "name string, book string"))
    r = out.first()
    assert (r["text"], r["quotes"], r["citations"]) == ("He said “a quote that the book does hold, whole and long”.\nend", 1, 0)
    # what was judged is written: nothing behind it reads the evidence again
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_chunks_of_a_long_line_without_sentences(spark):
    # a pattern that runs to the end from each place takes minutes for this line
    rows = [(1, "One is short. " * 3 + "word " * 60_000), (2, "a" * 1000 + "\n" + "b" * 1000), (3, None), (4, "word " * 60_000)]
    d = spark.createDataFrame(rows, "id int, t string")
    begun = time.monotonic()
    got = {r["id"]: r["c"] for r in d.select("id", chunking.chunk_overlap("t", separator="\n").alias("c")).collect()}
    assert time.monotonic() - begun < 60
    assert got[1] == ["One is short.  One is short.  One is short."] and got[3] is None and got[4] == [("word " * 60_000).strip()]
    assert got[2] == ["a" * 1000, "a" * 200 + "\n\n" + "b" * 1000]


def test_words_are_counted_before_they_are_rows(spark):
    d = spark.createDataFrame([("An apple, an À-lá öö x",), (None,), ("apple",)], "text string").coalesce(1)
    freq = index.word_frequency(d, LATIN)
    assert {r["word"]: r["freq"] for r in freq.collect()} == {"An": 1, "an": 1, "apple": 2, "lá": 1, "öö": 1}
    assert "Generate" not in freq._jdf.queryExecution().optimizedPlan().toString()


def test_window_hashes_take_a_pass_for_each_doubling():
    codes = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x1F3D5B79)
    for width in (1, 2, 7, 20, 32):
        plain = np.zeros(60 - width, np.uint64)
        for j in range(width):
            plain = plain * np.uint64(0x9E3779B97F4A7C15) + codes[j : 60 - width + j]
        assert (verify._window_hashes(codes, width) == (plain ^ (plain >> np.uint64(32)))).all()
        assert (verify._window_hashes(codes[None, :width], width)[0, 0] == verify._window_hashes(codes, width)[0])

    class Counted(np.ndarray):
        products = 0

        def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
            Counted.products += ufunc is np.multiply
            return getattr(ufunc, method)(*(np.asarray(x) for x in inputs), **kwargs).view(Counted)

    verify._window_hashes(codes.view(Counted), 20)
    assert Counted.products <= 6


@pytest.mark.parametrize("parts", ["1", "7"])
def test_pages_are_compared_with_the_one_before_in_one_shuffle(spark, parts):
    """Ranges that begin in a book, books of one page, empty and null texts, a null book; texts are neither joined nor written."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(120):
        book = None if i < 20 else "hot" if i < 100 else f"s{i // 2}"
        before = rows[-1][2] if rows and rng.random() < 0.5 else None
        rows.append((book, i, before or rng.choice(["", None, "a b", "one two three four", " ".join(rng.choices("abcdefgh", k=40))]), "x"))
    grams = lambda t: {tuple(w[j:j + 3]) for w in [(t or "").split()] for j in range(len(w) - 2)}
    for (a, _, x, _), (b, page, y, _) in zip(rows, rows[1:]):
        if a == b:
            both, every = grams(x) & grams(y), grams(x) | grams(y)
            want[page] = len(both) / len(every) if both else 0.0
    frame = spark.createDataFrame(rows, "book string, page int, text string, other string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        with Scratch(spark) as scratch:
            got = pages.like_previous(frame, scratch)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert len(got.collect()) == 120 and {r.page: r.similarity for r in got.collect() if r.similarity is not None} == want
            assert "SortMergeJoin" not in plan and "text" not in plan
        flagged = pages.flag_duplicate_pages(frame, mode="previous")
        assert flagged.columns == [*frame.columns, "duplicate"]
        assert sorted(map(str, flagged.collect())) == sorted(str(spark_row(r, want.get(r[1], 0) > 0.85)) for r in rows)
        assert pages.like_previous(frame.limit(0), Scratch(spark)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def spark_row(row, duplicate):
    return Row(book=row[0], page=row[1], text=row[2], other=row[3], duplicate=duplicate)
