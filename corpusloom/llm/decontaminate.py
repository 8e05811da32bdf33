"""Benchmark decontamination (1): greedy string tiling of documents against test passages.

Seeds are the hashes of all windows of five words of each passage. A document and a passage are a candidate pair if the
words of the passage under shared seeds reach the coverage threshold (tiles are unions of such windows, so this bounds
the coverage from above). Candidates are tiled: the longest common stretch that is not yet marked is found by running
Karp-Rabin over both, marked, and so on down to five words. Order doesn't matter to the sum, so reordered passages count.

The seeds are broadcast while they are at most `broadcast_seeds`; beyond it documents' windows are joined to the seeds
by a shuffle instead. Both ways give the same pairs.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import doc_key, rows_back, texts, whole_rows
from .shingles import WordHashes, windows

_WORD = re.compile(r"\w+")
PAIR = "k long, doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double"


def words(text: str, cache: WordHashes) -> np.ndarray:
    return cache.of(_WORD.findall(text.lower()))


def _longest(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, tuple | None]:
    """Longest window in low..high that both have unmarked (0 marks), and where; see _common."""
    best, found = 0, None
    while low <= high:
        size = (low + high) // 2
        if hits := _common(a, b, size):
            best, found, low = size, hits, size + 1
        else:
            high = size - 1
    return best, found


def _common(a: np.ndarray, b: np.ndarray, size: int) -> tuple | None:
    """Windows of `size` unmarked words that both have: their starts in a and, for each, from where to where b's starts lie
    in the last array. b's starts are listed once, however often a has the window."""
    if min(len(a), len(b)) < size:
        return None
    at = []
    for x in (a, b):
        marked = np.append(0, np.cumsum(x == 0))
        at.append(np.flatnonzero(marked[size:] == marked[:-size]))
    hash_a, hash_b = windows(a, size)[at[0]], windows(b, size)[at[1]]
    order = np.argsort(hash_b, kind="stable")
    left, right = (np.searchsorted(hash_b[order], hash_a, side) for side in ("left", "right"))
    hit = np.flatnonzero(right > left)
    return (at[0][hit], left[hit], right[hit], at[1][order]) if len(hit) else None


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length): longest first, then by place in the item, then in the doc."""
    item, doc, tiles = item.copy(), doc.copy(), []
    size = len(item)
    while size >= least:
        size, found = _longest(item, doc, least, min(size, len(doc)))
        if not size:
            break
        before, starts = len(tiles), found[3]
        next_of: dict[int, int] = {}  # what is marked stays marked: no start in the doc is tried twice
        for i, left, right in zip(*(x.tolist() for x in found[:3]), strict=True):
            if not item[i : i + size].all():
                continue
            p = next_of.get(left, left)
            while p < right:
                j = int(starts[p])
                p += 1
                if doc[j : j + size].all() and np.array_equal(item[i : i + size], doc[j : j + size]):
                    item[i : i + size] = 0
                    doc[j : j + size] = 0
                    tiles.append((i, j, size))
                    break
            next_of[left] = p
        size -= len(tiles) == before  # hashes alone were equal
    return tiles


class Seeds:
    """Windows of all passages, sorted by hash; passages under `k` words are a window of their own length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int):
        self.k, self.items = k, [(i, w) for i, w in items if len(w)]
        self.sizes = sorted({min(k, len(w)) for _, w in self.items})
        self.by_size = {}
        for size in self.sizes:
            own = [(n, w) for n, (_, w) in enumerate(self.items) if min(k, len(w)) == size]
            hashes = np.concatenate([windows(w, size) for _, w in own])
            which = np.concatenate([np.full(len(w) - size + 1, n) for n, w in own])
            start = np.concatenate([np.arange(len(w) - size + 1) for _, w in own])
            order = np.argsort(hashes, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = hashes[order], which[order], start[order], some

    def candidates(self, doc: np.ndarray, coverage: float) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the item, the doc with all but seed windows marked) where the bound reaches `coverage`."""
        for size in self.sizes:
            if len(doc) < size:
                continue
            hashes, which, start, some = self.by_size[size]
            met = windows(doc, size)
            at = np.flatnonzero(some[(met >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            left, right = np.searchsorted(hashes, met[at], "left"), np.searchsorted(hashes, met[at], "right")
            n = right - left
            if not n.any():
                continue
            seeds = np.unique(np.repeat(left - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()))
            under = (at[n > 0][:, None] + np.arange(size)).ravel()
            masked = None
            seeds = seeds[np.argsort(which[seeds], kind="stable")]
            items, first = np.unique(which[seeds], return_index=True)
            for i, own in zip(items, np.split(seeds, first[1:]), strict=True):
                covered = np.unique((start[own][:, None] + np.arange(size)).ravel())
                if len(covered) >= coverage * len(self.items[i][1]):
                    if masked is None:
                        # stretches under seeds, a 0 between them
                        under = np.unique(under)
                        gaps = np.flatnonzero(np.diff(under) > 1) + 1
                        masked = np.insert(doc[under], gaps, 0)
                    yield int(i), masked


def _pair(k, doc_id, item_id, item: np.ndarray, doc: np.ndarray, least: int, coverage: float):
    tiles = tile(item, doc, min(least, len(item)))
    matched = sum(x[2] for x in tiles)
    if matched >= coverage * len(item):
        yield k, doc_id, item_id, len(item), matched, len(tiles), matched / len(item)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in PAIR.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(names)], [n for n, _ in names]
    )


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 5, coverage: float = 0.5, broadcast_seeds: int = 1_000_000,
) -> DataFrame:
    """Pairs whose tiles cover at least `coverage` of the passage's words: PAIR's columns, one row per (k, item_id).

    Words are runs of letters, digits and `_`, lower-cased. A passage of fewer than k words counts as one stretch of its
    own length; one without words, or null, matches nothing; so do null and empty documents. Repeated rows (same id and
    text) give one row for each passage; with the same id and other text, the best coverage is kept. Passages of equal
    text are separate items. A null doc_id is told apart by a hash of the text (`k`). Very long texts are scanned whole. Of
    tiles that tie in length, the first in the passage and then in the document is marked. Either table empty: no pairs.
    Other columns are ignored, whatever their names.
    """
    rows = texts(docs, doc_id, text)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(item_text, F.lit("")).alias("item"))
    n_seeds = items.agg(F.sum(F.size(F.split("item", r"(?U)\W+")))).first()[0] or 0
    found = _by_broadcast(rows, items, k, coverage) if n_seeds <= broadcast_seeds else _by_join(rows, items, k, coverage)
    best = F.max_by(F.struct("doc_id", "item_words", "matched_words", "n_tiles", "coverage"), F.struct("coverage", F.negate("n_tiles"), "matched_words"))
    return found.groupBy("k", "item_id").agg(best.alias("x")).select("k", "item_id", "x.*")


def _by_broadcast(rows: DataFrame, items: DataFrame, k: int, coverage: float) -> DataFrame:
    cache = WordHashes()
    listed = [(r["item_id"], words(r["item"], cache)) for r in items.collect()]  # bounded by broadcast_seeds
    shared = rows.sparkSession.sparkContext.broadcast(Seeds(listed, k))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seeds = WordHashes(), shared.value
        for batch in batches:
            out = []
            for key, doc, whole in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, masked in seeds.candidates(words(whole, cache), coverage):
                    out += _pair(key, doc, *seeds.items[i], masked, k, coverage)
            cache.trim()
            yield _batch(out)

    return rows.select("k", "doc_id", "text").mapInArrow(scan, PAIR)


def _by_join(rows: DataFrame, items: DataFrame, k: int, coverage: float) -> DataFrame:
    # rows of one id and text are one passage; others that share an id, or have none, are told apart
    items = items.withColumn("row", F.xxhash64("item_id", "item")).dropDuplicates(["row"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(whole, cache)
                h, times = np.unique(windows(w, k), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(times), pa.array([min(k, len(w))] * len(h), pa.int64()), pa.array([len(w)] * len(h), pa.int64())],
                    ["row", "h", "times", "size", "n"],
                )
            cache.trim()

    of_items = items.select("row", "item").mapInArrow(seeds, "row long, h long, times long, size long, n long")
    sizes = [r[0] for r in of_items.select("size").distinct().collect()]  # at most k values

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(whole, cache)
                h = np.unique(np.concatenate([windows(w, s) for s in sizes if len(w) >= s] or [np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h.view(np.int64))], ["k", "h"])
            cache.trim()

    met = rows.select("k", "text").mapInArrow(of_docs, "k long, h long").distinct().join(of_items, "h")
    # each place of a seed in the passage covers at most `size` words of it
    pairs = met.groupBy("k", "row", "size", "n").agg((F.sum("times") * F.col("size")).alias("most"))
    pairs = pairs.where(F.col("most") >= coverage * F.col("n")).select("k", "row")
    both = rows.join(pairs, "k").join(items, "row").select("k", "doc_id", "text", "item_id", "item")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out = []
            for key, doc, whole, i, item in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                seeds = Seeds([(i, words(item, cache))], k)
                for _, masked in seeds.candidates(words(whole, cache), coverage):
                    out += _pair(key, doc, i, seeds.items[0][1], masked, k, coverage)
            cache.trim()
            yield _batch(out)

    return both.mapInArrow(scan, PAIR)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, whose text doesn't hold a passage of `benchmark`; see
    contaminated_pairs, also for nulls, repeated rows and empty tables."""
    bad = contaminated_pairs(docs, benchmark, doc_id=doc_id, text=text, **options).select("k").distinct()
    return rows_back(whole_rows(docs, k=doc_key(doc_id, text)).join(bad, "k", "left_anti"))
