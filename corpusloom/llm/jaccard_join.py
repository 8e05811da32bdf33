"""N-gram Jaccard join (6): a token-group matrix over prefix-filtered shingle sets.

Every text becomes the set of its distinct five-word shingles. Sets are ordered globally: by how often a shingle is met
(frequent ones last), then by hash. The first n - ceil(0.8 n) + s shingles of a set are its prefix, with a slack of
s = ceil(n / 20): two sets of Jaccard 0.8 or more have at least the smaller slack in common within their prefixes, which
is at least ceil(0.8 n / 20) for either.

1. Documents that share prefix shingles are partitioned into groups, named by the least set hash met most often; a group
   is dealt into blocks of bounded total size.
2. The matrix has a row for each (prefix shingle, block) that occurs: the token union of the block.
3. Every set is a query against the matrix. It opens a block only if the block's union holds enough of its prefix. It
   asks without those of its prefix shingles that most sets have, fewer of them than must be common, and with a bound
   that is lower by as many: no link is lost.
4. A task has the queries of two blocks against each other. A query is bounded once more, by its overlap with the whole
   union of the other side, before the sets there are opened. It returns a spanning forest of the links it verified,
   never all pairs; components are then joined up.

The sides of these joins grow with the input, so they are merged by shuffles at every size and never broadcast.

Equal sets are one set throughout, so groups of exact copies cost one row per task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut
from .components import connected_components
from .keys import doc_key, rows_back, texts, whole_rows
from .shingles import WordHashes, shingle_set

#: A shingle met this often in one batch is reported; the sum over batches ranks frequent shingles.
BATCH_DF = 4
#: Frequent shingles that are ranked, at most. Only the order depends on it, never the result: any one order is right.
RANKED = 100_000


#: The prefix is longer by n / SLACK shingles than one common shingle would take; as many must then be common.
SLACK = 20
#: Per cent of the slack that a query leaves out, its most frequent prefix shingles; the bound is lowered by as many.
DROPPED = 75


def prefix_length(n: int, percent: int) -> int:
    """Sets of Jaccard percent/100 have at least min(slack) shingles in common within these prefixes."""
    return min(n, n - (percent * n + 99) // 100 + (n + SLACK - 1) // SLACK)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles over all documents, rarest first. Bounded by RANKED; a hint for the order alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            seen: set[bytes] = set()
            sets = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                digest = xxhash.xxh3_128_digest(text)
                if digest not in seen:  # copies of a text are one set
                    seen.add(digest)
                    sets.append(shingle_set(text, cache, k))
            cache.trim()
            if sets:
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= BATCH_DF
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"]
                )

    rows = (
        docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(RANKED).collect()
    )
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """`k, doc_id, n, h, prefix`: set size, set hash, and the prefix (null where the task met the same set before)."""
    ranked = frequent_shingles(docs, k)
    by_value = np.argsort(ranked, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((ranked[by_value], by_value.astype(np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        values, ranks = shared.value
        for batch in batches:
            n, hashes, prefixes = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, cache, k)
                n.append(len(s))
                h = xxhash.xxh3_64_intdigest(s.tobytes())
                hashes.append(h)
                if not len(s) or h in seen:
                    prefixes.append(None)
                    continue
                seen.add(h)
                size = prefix_length(len(s), percent)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, ranks[at], -1)
                    s = s[np.argsort(rank, kind="stable")] if rank.max() >= 0 else s
                prefixes.append(s[:size].view(np.int64))
            cache.trim()
            if len(seen) > 500_000:
                seen.clear()  # a repeated prefix only costs rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                 pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(prefixes, pa.list_(pa.int64()))],
                ["k", "doc_id", "n", "h", "prefix"],
            )

    return docs.select("k", "doc_id", "text").mapInArrow(rows, "k long, doc_id long, n long, h long, prefix array<long>")


def _links(sides: list[int], hashes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between side 0 and side 1 (or within side 0, if there is no other)."""
    own = [i for i, x in enumerate(sides) if x == 0]
    other = [i for i, x in enumerate(sides) if x == 1] or own
    sizes = np.array([len(sets[i]) for i in other])
    tokens = np.concatenate([sets[i] for i in other])
    owner = np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    union, first = np.unique(tokens[order], return_index=True)
    last = np.append(first[1:], len(tokens))
    parent = list(range(len(sides)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for q in own:
        s = sets[q]
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if 100 * len(at) < percent * len(s):  # the bound: no set of the group can reach the threshold
            continue
        begin, count = first[at], last[at] - first[at]
        spans = np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        both = np.bincount(owner[spans], minlength=len(other))
        for j in np.flatnonzero(100 * both >= percent * (len(s) + sizes - both)):
            a, b = root(q), root(other[j])
            if a != b:
                parent[a] = b
                out.append((hashes[q], hashes[other[j]]))
    return out


def near_links(scratch: Scratch, docs: DataFrame, sets: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """`(u, v)`: verified links between set hashes, enough of them to connect all that are connected."""
    reps = sets.where("n > 0").groupBy("h").agg(F.min("k").alias("k"), F.first("n").alias("n"))
    token = sets.where("prefix is not null").select("h", F.explode("prefix").alias("token"))
    met = token.selectExpr(
        "token", "h", "min(h) over (partition by token) as low", "max(h) over (partition by token) as high",
        "count(*) over (partition by token) as f",
    )
    met = scratch.staged(met.where("low < high").drop("high").distinct())
    # groups of similar documents, named by the leader met most; dealt into blocks of about `block` shingles
    member = met.groupBy("h", "low").agg(F.count("*").alias("c"))
    member = member.groupBy("h").agg(F.sum("c").alias("c"), F.max_by("low", F.struct("c", "low")).alias("g"))
    need = F.expr(f"(n * {percent} + {100 * SLACK - 1}) div {100 * SLACK}")
    member = member.join(reps, "h").withColumn("need", need).where("c >= need")
    size = member.groupBy("g").agg(F.ceil(F.sum("n") / F.lit(block)).alias("parts"))
    member = scratch.staged(
        member.join(size, "g").select("h", "k", "need", F.xxhash64("g", F.pmod(F.xxhash64("h"), F.col("parts"))).alias("b"))
    )
    mine = met.join(member.select("h", "b", "need").hint("merge"), "h").selectExpr(
        "token", "h", "b", "need", f"need * {DROPPED} div 100 as r", "row_number() over (partition by h order by f desc, token) as i"
    )
    matrix = mine.groupBy("token", "b").agg(F.count("*").alias("m")).withColumnRenamed("b", "c")
    # queries against the matrix: how much of the prefix each group holds
    hits = mine.where("i > r").join(matrix, "token").where("b <> c or m > 1")
    hits = hits.groupBy("h", "b", "c").agg(F.count("*").alias("n"), F.first(F.col("need") - F.col("r")).alias("need"))
    hits = scratch.staged(
        hits.where("n >= need")
        .select("h", F.xxhash64(F.least("b", "c"), F.greatest("b", "c")).alias("pair"), F.expr("int(b > c)").alias("side"))
    )
    asked = hits.select("h").distinct().join(member.select("h", "k"), "h")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keep, found = [], []
            for i, (text, h) in enumerate(zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = shingle_set(text, cache, k)
                if np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64) == h:
                    keep.append(i)
                    found.append(s.tobytes())
            cache.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(keep, pa.int64())), pa.array(found, pa.binary())], ["h", "tokens"]
            )

    opened = (
        docs.select("k", "text").join(asked.hint("merge"), "k").select("text", "h")
        .mapInArrow(whole, "h long, tokens binary")
    )
    dealt = opened.join(hits.hint("merge"), "h").select("pair", "side", "h", "tokens")
    dealt = dealt.repartition("pair").sortWithinPartitions("pair")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = _links(*group, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        now, group = None, ([], [], [])
        for batch in batches:
            for pair, side, h, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pair != now:
                    if len(group[0]) > 1:
                        yield flush()
                    now, group = pair, ([], [], [])
                group[0].append(side)
                group[1].append(h)
                group[2].append(np.frombuffer(tokens, np.uint64))
        if len(group[0]) > 1:
            yield flush()

    return dealt.mapInArrow(verify, "u long, v long")


def ngram_jaccard_classes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = 400_000
) -> DataFrame:
    """`k, doc_id, n_shingles, component_id` for every row of `docs`.

    Two documents link when 100 * |A & B| >= percent * |A | B|; component_id is the smallest doc_id reachable. A text of
    fewer than k words is one shingle; a null or blank text is an empty set, linked with nothing. Rows of equal text
    (copies, repeated rows) share a component. A null doc_id never names a component unless no row in it has one; then a
    hash of the text does. Very long texts are shingled whole. Sets that tie share all, so no order among them matters. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = texts(docs, doc_id, text)
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.staged(shingle_sets(rows, k, percent))
        links = near_links(scratch, rows, sets, k, percent, block)
        roots = connected_components(links)
        found = sets.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("i"), F.min("k").alias("j"))
        found = found.join(roots, found.h == roots.node, "left").select("h", F.coalesce("root", "h").alias("root"), "i", "j")
        named = found.groupBy("root").agg(F.coalesce(F.min("i"), F.min("j")).alias("component_id"))
        found = found.join(named, "root").select("h", "component_id")
        empty = sets.where("n = 0").select("k", "doc_id", "n", F.col("k").alias("component_id"))
        full = sets.where("n > 0").join(found, "h").select("k", "doc_id", "n", "component_id")
        return cut(full.unionByName(empty).withColumnRenamed("n", "n_shingles"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, with one document of each component: the one that names it.

    Of rows that repeat both id and text, one stays. See ngram_jaccard_classes for links, nulls and empty texts.
    """
    classes = ngram_jaccard_classes(docs, doc_id=doc_id, text=text, **options)
    stay = classes.where("k = component_id").select("k").distinct()
    keyed = whole_rows(docs, k=doc_key(doc_id, text), hash=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return rows_back(keyed.join(stay, "k", "left_semi").dropDuplicates(["k", "hash"]))
