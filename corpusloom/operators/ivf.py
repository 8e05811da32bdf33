"""Semantic search by inverted vector lists: probe the nearest lists, scan int8 codes, rescore exactly.

Centroids are fitted on a sample of bounded size; every vector is put into the list of its nearest one. A query meets the
vectors of its nearest lists alone. There it is scored against their int8 codes, and the best of these by the vectors
themselves. `operators.vectors.vector_topk` is the exact way over all vectors.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import PART, _matrix, vector_topk

#: Rows that centroids are fitted on, centroids at most, and rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 12


def fit_lists(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of length 1 by k-means on cosine: `lists` of them, or the square root of the vectors' number.

    The driver gets `sample` vectors at most, those of the least hashes of id, whatever the table's size."""
    if lists is None:
        lists = min(MOST_LISTS, max(1, round(math.sqrt(vectors.count()))))
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _matrix(rows)
    centroids = x[: min(lists, len(x))].copy()
    for _ in range(ROUNDS if len(x) > len(centroids) else 0):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def _nearest(table: pa.Table, centroids: np.ndarray, n: int) -> np.ndarray:
    scores = _matrix(table) @ centroids.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def index_vectors(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`id, v, list, code, scale` of every vector: its list, and its int8 code (see vectors.quantise) as bytes."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS rows at most

    def assign(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            unit = _matrix(table)
            scale = np.abs(unit).max(axis=1, initial=0.0)
            code = np.clip(np.floor(unit / np.maximum(scale, 1e-300)[:, None] * 127 + 0.5), -127, 127).astype(np.int8)
            own = _nearest(table, shared.value, 1)[:, 0] if len(shared.value) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)],
                ["id", "v", "list", "code", "scale"],
            )

    rows = vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(assign, "id long, v array<double>, list int, code binary, scale double")


def semantic_topk(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, *, probe: int, rescore: int = 4, least: float | None = None) -> DataFrame:
    """`(query_id, id, score, rank)`: the k best found in the `probe` lists nearest to each query (query_id, v); ties by id.

    Of each part of a list the rescore * k best by code are scored exactly. A list is dealt by hash into parts of bounded
    size, so a large one is many tasks. least: only scores from there on. An empty index finds nothing.
    """
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    # as many parts as the largest list takes at PART vectors each: one row a list
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))

    def ask(batches):
        for batch in batches:
            near = _nearest(pa.Table.from_batches([batch]), shared.value, probe) if len(shared.value) else np.zeros((batch.num_rows, 0), int)
            at = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["query_id", "v", "list"])

    asked = queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<double>").alias("v")).mapInArrow(ask, "query_id long, v array<double>, list int")
    asked = asked.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = index.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def best(q: pa.Table, part: pa.Table) -> pa.Table:
        names, ids = q["query_id"].to_numpy(), part["id"].to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(names) and len(ids):
            unit, exact = _matrix(q), _matrix(part)
            codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32)
            rough = (unit.astype(np.float32) @ codes.T) * part["scale"].to_numpy().astype(np.float32)
            n = min(rescore * k, len(ids))
            some = np.argpartition(-rough, n - 1, axis=1)[:, :n]
            scores = np.round(np.einsum("qd,qnd->qn", unit, exact[some]), 9)
            order = np.lexsort((ids[some], -scores), axis=1)[:, :k]
            top, own = np.take_along_axis(scores, order, 1), np.take_along_axis(ids[some], order, 1)
            out = [np.repeat(names, top.shape[1]), own.ravel(), top.ravel()]
        return pa.table(dict(zip(("query_id", "id", "score"), out, strict=True)))

    met = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInArrow(best, "query_id long, id long, score double")
    if least is not None:
        met = met.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_for(index: DataFrame, centroids: np.ndarray, k: int, *, target: float = 0.95, asked: int = 200) -> int:
    """How many lists must be probed for `target` of the exact k best: measured with `asked` vectors of least hash as queries.

    Clustered vectors need few lists, vectors without structure a large share of them. The driver gets asked * k rows."""
    some = index.select(F.col("id").alias("query_id"), "v").orderBy(F.xxhash64("query_id"), "query_id").limit(asked)
    exact = vector_topk(some, index.select("id", "v"), k).select("query_id", "id").join(index.select("id", "list"), "id")
    rows = exact.join(some, "query_id").select("v", "list").toArrow()
    if not rows.num_rows:
        return 1
    order = _nearest(rows, centroids, len(centroids))
    place = (order == rows["list"].to_numpy()[:, None]).argmax(axis=1)
    return int(np.quantile(place, target, method="higher")) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """`(recall)`: the share of the exact results (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
