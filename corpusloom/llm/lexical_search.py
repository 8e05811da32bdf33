"""Ranked lexical search (12): dense blocked matrix products of item vocabulary tiles and document impact tiles.

Items are dealt into blocks of bounded vocabulary. For each block the documents are read twice: once for the counts that
the weights need (N, L and the document frequency of the block's terms), once to score. There a tile holds some hundred
documents: their integer impacts by those terms of the block that occur in the tile, as a dense float64 matrix. It is
multiplied by the block's matrix of weights times repeats, in tiles of terms so narrow that no sum can pass 2^53; so each
product is exact, and the products are added up as 64-bit integers. Every task keeps the k best of each item, ties by
doc_id, and no score that ties with the last of them is lost on the way; the tasks' bests are merged in two steps.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .importance import PLAIN
from .keys import texts

#: Words of the items of a block, documents of a tile, terms of a tile.
BLOCK_WORDS, TILE_DOCS, TILE_TERMS = 20_000, 512, 8192
#: Every impact lies below this: 10^9 tf / (1000 tf + 12 m).
MOST_IMPACT = 10**6
EXACT = 2**53
#: Groups in which the tasks' bests of an item are merged before they come together.
MERGERS = 64
NO_ID = np.iinfo(np.int64).max  # a null doc_id comes last among ties


def terms(text: str) -> list[bytes]:
    """Letters and digits side by side, and all that isn't ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Block:
    """Items of one block: `keys`, their terms' places in the vocabulary, and how often each item has them."""

    def __init__(self, items: list[tuple[int, int | None, str]]):
        self.items = [(row, i) for row, i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.cells: list[tuple[int, int, int]] = []
        for at, (_, _, text) in enumerate(items):
            for term, times in Counter(terms(text)).items():
                self.cells.append((at, self.vocabulary.setdefault(term, len(self.vocabulary)), times))

    def places(self, found: list[bytes]) -> np.ndarray:
        """The vocabulary's places of a document's terms, -1 for those that no item has."""
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int32, len(found))


def term_tiles(most: np.ndarray) -> list[np.ndarray]:
    """Places of the terms (of these greatest weights) in tiles whose products can't pass EXACT; too heavy ones alone."""
    tiles, now, total = [], [], 0
    for i, x in enumerate(most.tolist()):
        if now and (total + x * MOST_IMPACT > EXACT or len(now) == TILE_TERMS):
            tiles.append(np.array(now))
            now, total = [], 0
        now.append(i)
        total += x * MOST_IMPACT
    return [*tiles, np.array(now)] if now else tiles


def tile_scores(weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Exact product of integer matrices (items x terms) and (terms x documents)."""
    total = np.zeros((len(weights), impacts.shape[1]), np.int64)
    for at in term_tiles(weights.max(axis=0, initial=0)):
        w, x = weights[:, at], impacts[at]
        if len(at) == 1 and int(w.max()) * MOST_IMPACT > EXACT:
            total += w * x
        else:
            total += (w.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    return total


class Best:
    """The k best scores above 0 of each item so far: higher ones first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.zeros((n, k), np.int64), np.full((n, k), NO_ID)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        met = np.flatnonzero((scores >= np.maximum(self.scores[:, -1:], 1)).any(axis=1))
        if not len(met):
            return
        s = np.hstack([self.scores[met], scores[met]])
        i = np.hstack([self.ids[met], np.broadcast_to(ids, (len(met), len(ids)))])
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[met], self.ids[met] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _counts(rows: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each term of the block is."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, docs, length = np.zeros(len(own.vocabulary), np.int64), 0, 0
        for batch in batches:
            for t in batch.column(0):
                found = terms(t.as_py())
                docs, length = docs + bool(found), length + len(found)
                met = np.unique(own.places(found))
                df[met[met >= 0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([docs, length, *df[at].tolist()], pa.int64())], ["term", "n"])

    met = rows.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in met.collect()}  # as many rows as the block has terms, and two
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(block.vocabulary))], np.int64)


def _search(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """`row, item_id, doc_id, score`: the k best of each item of the block in each task."""
    n_docs, length, df = _counts(rows, block)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((block, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        weights = np.zeros((len(block.items), len(weight)), np.int64)
        for item, term, times in block.cells:
            weights[item, term] = times * weight[term]
        best, tile = Best(len(block.items), k), []

        def flush() -> None:
            used, at = np.unique(np.concatenate([x[1] for x in tile]), return_inverse=True)
            impacts = np.zeros((len(used), len(tile)), np.int64)
            impacts[at, np.repeat(np.arange(len(tile)), [len(x[1]) for x in tile])] = np.concatenate([x[2] for x in tile])
            best.add(tile_scores(weights[:, used], impacts), np.array([x[0] for x in tile], np.int64))
            tile.clear()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(t.as_py())
                met = block.places(found)
                own, tf = np.unique(met[met >= 0], return_counts=True)
                if not len(own):
                    continue
                m = 100 - 25 + (25 * len(found) * n_docs) // length
                tile.append((NO_ID if i is None else i, own, (10**9 * tf) // (1000 * tf + 12 * m)))
                if len(tile) == TILE_DOCS:
                    flush()
        if tile:
            flush()
        at, place = np.nonzero(best.scores)
        ids = best.ids[at, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.items[i][0] for i in at], pa.int64()), pa.array([block.items[i][1] for i in at], pa.int64()),
             pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(best.scores[at, place], pa.int64())],
            ["row", "item_id", "doc_id", "score"],
        )

    return rows.select("doc_id", "text").mapInArrow(search, "row long, item_id long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 20, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k documents of highest score above 0 of each item.

    Equal scores rank by doc_id, a null one last. Null, empty and wordless texts have no terms: such documents are never
    found and don't count, such items find nothing. Repeated documents are found each. Rows of `items` that repeat id and
    text are one; those that share an id alone are ranked apart under it. Very long texts are read whole. A table without
    rows gives none; other columns are ignored, whatever their names. Items are dealt by hash into blocks of about
    `block_words` words, each of which reads the documents twice.
    """
    rows = texts(docs, doc_id, text)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = asked.select(F.xxhash64("item_id", "text").alias("row"), "item_id", "text").dropDuplicates(["row"])
    words = asked.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks, found = max(1, math.ceil(words / block_words)), None
    for b in range(blocks):
        block = asked.where(F.pmod("row", F.lit(blocks)) == b).orderBy("row").collect()  # some block_words words
        part = _search(rows, Block([tuple(r) for r in block]), k)
        found = part if found is None else found.unionByName(part)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # a task's k best of an item, merged in MERGERS groups and then over these
    met = found.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("row", "at").orderBy(*order))).where(F.col("rank") <= k)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
