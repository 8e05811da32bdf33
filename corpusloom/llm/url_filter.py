"""URL filters (9): rules first, then naive Bayes over words into which host names are segmented.

A unigram model of words comes from the text of all pages. A host name's labels are split into its most probable words
(Viterbi); path segments are cut at all but letters and split alike. Every distinct name is split once, with the counts of
those of its substrings that are words, which a join brings; so no list of words is sent around. Multinomial naive Bayes
over these tokens is trained on the pages that a rule decides, and judges the others; tokens meet their odds in a join.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut

#: The rules of the contract (verdict, host and path).
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first by text) and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


HEAD = 24  # a word of the model meets a name by at most so many of its first letters
BLOCK = 256  # places of a name whose substrings one row holds
MICRO = 1_000_000  # log probabilities are whole millionths, so that equal splits are equal in every order of adding


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """`w, n`: how often each word of two letters or more occurs in the text of all pages."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html), F.lit(""))), r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]*>|&\w+;", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 2)
    return words.groupBy("w").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`name, words` for every row `id, name`: distinct names of any length, numbered in a written table.

    A name is cut into blocks of places, each with the letters that substrings from there reach; substrings travel with the
    number of their name, never with the name. Words longer than HEAD letters meet names by their first HEAD letters, and
    segment() sees whether the rest follows.
    """
    size = F.length("name")
    blocks = names.select("id", size.alias("size"), F.explode(F.sequence(F.lit(1), size, F.lit(BLOCK))).alias("at"), "name")
    blocks = blocks.select("id", "size", F.substr("name", "at", F.lit(BLOCK + HEAD - 1)).alias("part"))
    substrings = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("part"), F.lit(BLOCK))), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("part") - i + 1)), lambda n: F.substr("part", i, n))))
    pieces = blocks.select("id", "size", F.explode(F.array_distinct(substrings)).alias("head")).where(F.length("head") > 1)
    model = counts.select(F.substring("w", 1, HEAD).alias("head"), "w", "n")
    met = pieces.join(model, "head").where(F.length("w") <= F.col("size"))
    per_name = met.groupBy("id").agg(F.collect_list("w").alias("w"), F.collect_list("n").alias("n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for name, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words.append(segment(name, {x: log_probability(y, total) for x, y in zip(w or (), n or (), strict=True)}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(per_name, "id", "left").select("name", "w", "n").mapInArrow(split, "name string, words array<string>")


def log_probability(n: int, total: int) -> int:
    return round(MICRO * math.log(n / total))


def segment(name: str, model: dict[str, int], total: int) -> list[str]:
    """Most probable split of a name by the log probabilities of words; `total` is how many words the model was counted on.

    A piece that is no word is less probable than any word, and the more so the longer it is. Words and such pieces may
    have any length. Of equal splits, the one whose last piece is the shortest, and so on towards the front.
    """
    unknown, letter = round(-MICRO * max(math.log(1e9), math.log(total))), round(2.3 * MICRO)
    sizes = sorted({len(w) for w in model})
    best, cuts = [0], [0]
    ends: dict[int, list[tuple[int, int]]] = {}  # words that end at a place: how probable up to there, and where they begin
    opened = (0, 0)  # the best place for a piece that is no word to begin: its value freed of its letters' cost
    for i in range(len(name)):
        for n in sizes:
            if i + n > len(name):
                break
            known = model.get(name[i : i + n])
            if known is not None:
                ends.setdefault(i + n, []).append((best[i] + known, i))
        opened = max(opened, (best[i] + letter * i, i))
        value, cut = max([(opened[0] + unknown - letter * (i + 1), opened[1]), *ends.pop(i + 1, ())])
        best.append(value)
        cuts.append(cut)
    out, i = [], len(name)
    while i:
        out.append(name[cuts[i] : i])
        i = cuts[i]
    return out[::-1]


def filter_urls(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, smoothing: float = 1.0
) -> DataFrame:
    """`page_id, host, path, rule, verdict, block_odds, tokens` for every row.

    verdict is the rule's or, where no rule fits, block if the log odds of naive Bayes are above 0 and else allow; so a
    null url, or one without `://` (host and path empty), gets the verdict of no tokens at all: the prior's. If no page
    is decided by a rule, or all alike, the rest follow the prior. Rows that repeat a page are judged each and weigh in
    as many times. A token of no ruled page tells nothing. Of rules that tie in length the first by text wins, of
    splits that tie the one with the later cut. Very long urls and texts are read whole. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    with Scratch(pages.sparkSession) as scratch:
        return cut(_judged(scratch, pages, page_id, url, html, rules, smoothing))


def _judged(scratch: Scratch, pages: DataFrame, page_id: str, url: str, html: str, rules, smoothing: float) -> DataFrame:
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    # rows are numbered once: what is written keeps its numbers
    parsed = scratch.staged(parsed.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")
    ))
    sides = F.explode(F.array(F.struct(F.lit("h").alias("side"), F.col("host").alias("text")), F.struct(F.lit("p").alias("side"), F.col("path").alias("text"))))
    names = parsed.select("row", sides.alias("x")).select(
        "row", "x.side", F.posexplode(F.regexp_extract_all(F.lower("x.text"), F.lit(r"\p{L}+"), F.lit(0))).alias("at", "name")
    )
    counts = scratch.staged(word_counts(pages, html))
    total = counts.agg(F.sum("n")).first()[0] or 1
    distinct = scratch.staged(names.select("name").distinct().select(F.monotonically_increasing_id().alias("id"), "name"))
    words = scratch.staged(segmented(distinct, counts, total))
    tokens = names.join(words, "name").select(
        "row", "side", "at", F.transform("words", lambda w: F.concat("side", F.lit(":"), w)).alias("words")
    )
    tokens = tokens.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "at", "words"))), lambda x: x["words"])).alias("tokens"))
    rows = scratch.staged(parsed.join(tokens, "row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))
    scratch.drop(parsed, counts, distinct, words)

    ruled = rows.where("ruled is not null")
    pages_of = {r["ruled"]: r["n"] for r in ruled.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    seen = ruled.select("ruled", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")
    )
    sums = seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    bottom = {x: (sums[x] or 0) + smoothing * (sums["v"] or 1) for x in "ab"}
    odds = seen.select("token", (F.log((F.col("b") + smoothing) / bottom["b"]) - F.log((F.col("a") + smoothing) / bottom["a"])).alias("odds"))
    prior = math.log(pages_of.get("block", 0) + smoothing) - math.log(pages_of.get("allow", 0) + smoothing)
    score = rows.select("row", F.explode("tokens").alias("token")).groupBy("row", "token").count().join(odds, "token")
    score = score.groupBy("row").agg(F.sum(F.col("count") * F.col("odds")).alias("score"))
    out = rows.join(score, "row", "left").withColumn("block_odds", F.round(F.lit(prior) + F.coalesce("score", F.lit(0.0)), 9))
    judged = F.coalesce("ruled", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), "block_odds", "tokens")
