"""Line dedup (10), native: exact set-similarity join of lines by word sets; later matches go.

A line is the set of its words (64-bit hashes). Words are ordered by rarity over all distinct lines (the logarithm of the
count for the most frequent words, the rest before them, then by hash), so that two sets of Jaccard 0.8 or more share a
word within their first n - ceil(0.8 n) + 1.

1. Equal sets are one, placed where it is met first. The sets lie in a table bucketed by their hash; they are shuffled once.
2. Every set is posted at its prefix words. Postings of a word meet in a semi-join, filtered by length, by position (what
   can still be common behind the places of the word) and by a 128-bit parity sketch, which the symmetric difference
   bounds. It stops at the first partner, so it puts out each posting once at most, however large a group is. A word
   with many postings (HOT) is none by itself: two sets that share it first share a second word too, within one place more,
   and meet at such a pair of words.
3. Of what is left, each set is verified (exact Jaccard) with the earliest set at the same word: one pair a set and
   leader. Sets that no leader matches are then probed against all earlier ones, again up to the first match.

Intermediate tables are dropped at the end, by an error too; the numbers of the kept lines stay, as they are the result.
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, staged
from .keys import doc_key, texts, whole_rows

#: Words are counted by the low bits of their hash, in a table of fixed size; those that share a slot share a class. That
#: moves them in the order, which is one order for all lines all the same.
SLOTS = 1 << 17
#: A word with more postings than this is posted in pairs with the words after it; over STEADY sets the number grows with
#: their square root, since pairs are more rows: a set of n prefix words has up to n * (n + 1) / 2.
HOT, STEADY = 4096, 400_000
#: Sets of so many words have the wide sketch.
WIDE = 80


def may_differ(n: Column, percent: int) -> Column:
    """Whether a set of n words can match one that isn't equal: at best one with a word more."""
    return 100 * n >= percent * (n + 1)


def plain_lines(text: Column) -> Column:
    """Lines, lower-cased, with blanks as their only white space."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("\v") | text.contains("\f")
    return F.split(F.lower(F.when(odd, F.translate(text, "\t\r\v\f", "    ")).otherwise(text)), "\n")


def has_words(line: Column, least: int) -> Column:
    """Whether a line (of any white space) has at least `least` words."""
    if least == 1:
        return F.ltrim(line, F.lit(" \t\n\v\f\r")) != ""
    return line.rlike(rf"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{least - 1}}}[^\x20\x09-\x0D]")


def line_sets(rows: DataFrame, least: int) -> DataFrame:
    """`h, k, line, w`: every distinct set of word hashes, and the first line that has it."""
    lines = rows.select("k", F.posexplode(plain_lines(F.col("text"))).alias("line", "t")).where(has_words(F.col("t"), least))
    words = F.array_remove(F.transform(F.split("t", " "), lambda x: F.xxhash64(x)), F.xxhash64(F.lit("")))
    lines = lines.select("k", "line", F.sort_array(F.array_distinct(words)).alias("w"))
    lines = lines.select(F.xxhash64("w").alias("h"), F.struct("k", "line", "w").alias("m"))
    return lines.groupBy("h").agg(F.min("m").alias("m")).select("h", "m.k", "m.line", "m.w")


def rarity_classes(sets: DataFrame) -> list[int]:
    """A class for each slot: twice the logarithm of how often its words occur in all sets. SLOTS rows at most."""
    counts = sets.select(F.explode("w").alias("x")).groupBy(F.col("x").bitwiseAND(SLOTS - 1).alias("slot")).count()
    classes = [0] * SLOTS
    for slot, n in counts.collect():
        classes[slot] = int(2 * math.log2(n))
    return classes


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """`h, n, p, q, prefix, next`: of each set that can match another, its size, its sketch and its first words; `next` is
    the word after them where one of them may be hot by its class, else null.

    A word is its class above 56 bits of its hash here, so that its order is the order by rarity. Words that share both
    only cost a verification more. Parity sketch: each word flips one of 128 bits, the lower half in p, the upper in q;
    for sets of under WIDE words the halves lie on each other in p.
    """
    # small numbers, since every string of the plan repeats them in the driver
    classes = F.from_json(F.lit(json.dumps(rarity_classes(sets), separators=(",", ":"))), "array<tinyint>")
    # never null, so that the words are sorted as plain numbers
    above = lambda x: F.shiftleft(F.coalesce(F.get(classes, x.bitwiseAND(SLOTS - 1).cast("int")), F.lit(0).cast("tinyint")).cast("bigint"), 56)
    ranked = F.transform("w", lambda x: above(x).bitwiseOR(x.bitwiseAND((1 << 56) - 1)))
    flip = "s ^ shiftleft(1L, int(x & 63))"
    p = f"if(n < {WIDE}, aggregate(w, 0L, (s, x) -> {flip}), aggregate(w, 0L, (s, x) -> if(x & 64 = 0, {flip}, s)))"
    q = f"if(n < {WIDE}, 0L, aggregate(w, 0L, (s, x) -> if(x & 64 = 0, s, {flip})))"
    prefix = f"slice(r, 1, int(n - (n * {percent} + 99) div 100 + 1))"
    found = sets.where(may_differ(F.size("w"), percent)).select("h", "w", F.size("w").alias("n"))
    found = found.select("h", "n", F.expr(p).alias("p"), F.expr(q).alias("q"), F.sort_array(ranked).alias("r"))
    found = found.select("h", "n", "p", "q", "r", F.expr(prefix).alias("prefix"))
    may_be_hot = F.expr("element_at(prefix, -1)") >= F.lit(int(2 * math.log2(HOT)) << 56)
    following = F.coalesce(F.get("r", F.size("prefix")), F.lit(0))
    return found.select("h", "n", "p", "q", "prefix", F.when(may_be_hot, following).alias("next"))


def hot_words(found: DataFrame) -> DataFrame:
    """`x, hot`: the words with over HOT postings (see there for many sets); only those of a class that frequent are counted."""
    most = HOT * max(1.0, (found.count() / STEADY) ** 0.5)
    posted = found.where("next is not null").select(F.explode("prefix").alias("x"))
    posted = posted.where(F.col("x") >= F.lit(int(2 * math.log2(HOT)) << 56)).groupBy("x").count()
    return posted.where(F.col("count") > most).select("x", F.lit(True).alias("hot"))


def postings(found: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """`h, x, p, q, at`: a row for each prefix word x, or for each pair of a hot one and a word after it, up to `next`; `at`
    holds the set's size and the place of the first of them.

    The l-th word that two matching sets share is within n - ceil(0.8 n) + l of either, so that they meet at the first
    or, if that is hot, at the first two. Sets so small that one common word may do are posted at both.
    """
    at = "(bigint(least(n, 65535)) << 16) | least(i, 65535)"
    posted = found.select("h", "n", "p", "q", "prefix", "next", F.posexplode("prefix").alias("i", "x"))
    # hot words are few, one for each HOT postings at most: without a broadcast every set would be shuffled for each prefix word
    posted = posted.join(F.broadcast(hot), "x", "left")
    # one chain of explodes: a semi-join goes through a union, and then each part of it is shuffled beside the whole
    after = "array_append(slice(prefix, i + 2, size(prefix)), next)"
    seconds = f"if(hot is null, array(null), if(n * {percent} > 100, {after}, array_append({after}, null)))"
    posted = posted.select("h", "n", "p", "q", "i", "x", F.explode(F.expr(seconds)).alias("y"))
    return posted.selectExpr("h", "if(y is null, x, xxhash64(x, y)) as x", "p", "q", f"{at} as at")


def _near(percent: int) -> str:
    """The filters on postings a and b of two sets at one word, as SQL; true wherever the sets can match.

    Sets of n and m words that match differ in at most (n + m) * (100 - percent) / (100 + percent) words.
    """
    n, m, i, j = "(a.at >> 16)", "(b.at >> 16)", "(a.at & 65535)", "(b.at & 65535)"
    few = f"* {100 + percent} <= {100 - percent} * ({n} + {m})"
    return (
        f"a.x = b.x and bit_count(a.p ^ a.q ^ b.p ^ b.q) {few}"
        f" and (least({n}, {m}) < {WIDE} or (bit_count(a.p ^ b.p) + bit_count(a.q ^ b.q)) {few})"
        f" and 100 * {n} >= {percent} * {m} and 100 * {m} >= {percent} * {n}"
        f" and (greatest({n}, {m}) = 65535"  # the place is not known in longer sets
        f" or (least({i}, {j}) + least({n} - {i}, {m} - {j})) * {100 + percent} >= {percent} * ({n} + {m})) and a.h <> b.h"
    )


def _alike(percent: int) -> str:
    same = "size(array_intersect(a.w, b.w))"
    return (
        f"100 * size(a.w) >= {percent} * size(b.w) and 100 * size(b.w) >= {percent} * size(a.w)"
        f" and 100 * {same} >= {percent} * (size(a.w) + size(b.w) - {same})"
    )


def kept_lines(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """`(k, line)` of the lines that stay, of those with at least `least` words."""
    with Scratch(rows.sparkSession) as scratch:
        sets = scratch.bucketed(line_sets(rows, least), "h")
        found = scratch.staged(prefixes(sets, percent))
        near = F.expr(_near(percent))
        # both sides have the same columns, so that they are one shuffle
        hot = scratch.staged(hot_words(found))
        a, b = (postings(found, hot, percent).alias(side) for side in "ab")
        some = scratch.staged(a.join(b.hint("merge"), near, "left_semi"))
        scratch.drop(found, hot)
        # from here on only sets that have a partner matter
        table = scratch.bucketed(sets.join(some.select("h").distinct().hint("merge"), "h", "left_semi"), "h")
        met = scratch.staged(some.join(table.select("h", "k", "line").hint("merge"), "h"))
        words = table.select("h", "w").hint("merge")
        # most match the earliest one at a word: a pair for each set and leader, not for each two sets
        first = met.groupBy("x").agg(F.min(F.struct("k", "line", "h", "p", "q", "at")).alias("m"))
        first = first.select("x", "m.h", "m.p", "m.q", "m.at").alias("b").hint("merge")
        led = met.alias("a").join(first, near).select(F.col("a.h").alias("h"), F.col("b.h").alias("g"))
        pairs = led.groupBy("h").agg(F.collect_set("g").alias("g")).join(words, "h")
        leaders = words.withColumnRenamed("h", "g").hint("merge")
        pairs = pairs.select("h", "w", F.explode("g").alias("g")).alias("a").join(leaders.alias("b"), "g")
        gone = scratch.staged(pairs.where(_alike(percent)).select("h").distinct())
        # the others are probed against all earlier sets at the same word, up to the first match
        follows = f"{_near(percent)} and (b.k < a.k or b.k = a.k and b.line < a.line)"
        left = met.join(gone.hint("merge"), "h", "left_anti").alias("a")
        left = scratch.staged(left.join(met.alias("b").hint("merge"), F.expr(follows), "left_semi"))
        right = met.alias("b").join(left.alias("a").hint("merge"), F.expr(follows), "left_semi").join(words, "h")
        match = F.expr(f"{follows} and {_alike(percent)}")
        more = left.join(words, "h").alias("a").join(right.alias("b").hint("merge"), match, "left_semi")
        kept = sets.select("h", "k", "line").join(gone.unionByName(more.select("h")).distinct().hint("merge"), "h", "left_anti")
        return staged(kept.select("k", "line"))


def _judged(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """`k, kept`: numbers of kept lines, per document that has any."""
    return kept_lines(rows, percent, least).groupBy("k").agg(F.collect_set("line").alias("kept"))


def line_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, least: int = 5) -> DataFrame:
    """`k, doc_id, n_lines, n_removed, removed` for every row; `removed` lists line numbers from 0.

    Lines are cut at newlines; a line goes if an earlier one (by doc_id, then line number) has a word set with
    100 * |A & B| >= percent * |A | B|, whether or not that one stays; so of lines that tie in everything but their place,
    the first stays. Lines of fewer than `least` words always stay; with least=1, as the registered queries have it, only
    lines without a word do. Case is dropped. Null and empty texts have one empty line; very long texts are judged
    whole, line by line. Rows that repeat a doc_id count as one document: a line stays in all of them if it stays at
    that number in one. A null doc_id is replaced by a hash of the text. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = texts(docs, doc_id, text)
    long = F.filter(F.transform("lines", lambda t, i: F.when(has_words(t, least), i)), lambda i: i.isNotNull())
    per_doc = rows.select("k", "doc_id", F.split("text", "\n").alias("lines"))
    per_doc = per_doc.select("k", "doc_id", F.size("lines").cast("long").alias("n_lines"), long.alias("long"))
    gone = F.array_except("long", F.coalesce("kept", F.array().cast("array<int>")))
    out = per_doc.join(_judged(rows, percent, least), "k", "left").select("k", "doc_id", "n_lines", F.array_sort(gone).alias("gone"))
    return out.select("k", "doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, least: int = 5) -> DataFrame:
    """`docs` with repeated lines taken out of `text`; all columns stay, whatever their names. See line_report for which
    lines go, and for nulls, ties, repeated rows and empty tables.

    A document left without a word by it goes; one that had none before stays.
    """
    judged = _judged(texts(docs, doc_id, text), percent, least)
    both = whole_rows(docs, k=doc_key(doc_id, text)).join(judged, "k", "left")
    whole = F.col("row").getField(text)
    short = F.exists(F.split(whole, "\n"), lambda t: has_words(t, 1) & ~has_words(t, least)) if least > 1 else F.lit(False)
    left = both.where(F.coalesce(F.col("kept").isNotNull() | ~has_words(whole, 1) | short, F.lit(True)))
    stays = F.filter(F.split(whole, "\n"), lambda t, i: ~has_words(t, least) | F.coalesce(F.array_contains("kept", i), F.lit(False)))
    new = F.when(whole.isNotNull(), F.array_join(stays, "\n"))
    return left.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
