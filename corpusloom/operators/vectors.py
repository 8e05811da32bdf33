"""Vector search over a table of queries, quantisation, pooling and score statistics."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that meet a part of the vectors at once, vectors of a part, and vectors of one matrix product.
BLOCK, PART, SLICE = 4096, 50_000, 2048


def l2_normalise(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def quantise(v: Column) -> Column:
    """struct(scale, q): scale is the largest magnitude of the normalised vector, q its values in steps of scale / 127."""
    unit = l2_normalise(v)
    scale = F.array_max(F.transform(unit, F.abs))
    q = F.transform(unit, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x / F.nullif(scale, F.lit(0.0)) * 127 + 0.5))).cast("tinyint"))
    return F.struct(scale.alias("scale"), F.coalesce(q, F.transform(v, lambda x: F.lit(0).cast("tinyint"))).alias("q"))


def dequantised_dot(a: Column, b: Column) -> Column:
    """Dot product of a quantised vector with a plain one."""
    return F.aggregate(F.zip_with(a["q"], b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) * a["scale"] / 127


def _met(queries: DataFrame, vectors: DataFrame, by: list[str]):
    """Blocks of queries cogrouped with parts of the vectors: every query meets every vector once, in (block, part).

    Both are dealt by hash, so blocks and parts grow in number with the tables and not in size; nothing goes through the
    driver but two counts.
    """
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(vectors.count() / PART))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.col("v").cast("array<double>").alias("v")
    q = queries.select(deal("query_id", blocks).alias("block"), every(parts).alias("part"), F.col("query_id").cast("long"), v, *by)
    own = vectors.select(every(blocks).alias("block"), deal("id", parts).alias("part"), F.col("id").cast("long"), v, *by)
    return q.groupBy("block", "part").cogroup(own.groupBy("block", "part"))


def _matrix(table: pa.Table) -> np.ndarray:
    """The column v as rows of length 1; zero vectors stay."""
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, same_book: bool = False) -> DataFrame:
    """`(query_id, id, score, rank)`: k best by cosine, ties by id, over all vectors (id, v[, book]).

    queries: (query_id, v[, book]), any number of them. Blocks of queries meet parts of the vectors as matrix products; a
    part gives its own k best per query, so the last shuffle moves k rows per query and part, never all scores. Zero
    vectors score 0.
    """

    def best(asked: pa.Table, part: pa.Table) -> pa.Table:
        names, ids = (t[c].to_numpy() for t, c in ((asked, "query_id"), (part, "id")))
        q, v = _matrix(asked), _matrix(part)
        books = [np.array([str(x) for x in t["book"].to_pylist()]) for t in (asked, part)] if same_book else None
        out: list[tuple] = []
        for i in range(0, len(ids) if len(names) else 0, SLICE):
            own = ids[i : i + SLICE]
            scores = np.round(q @ v[i : i + SLICE].T, 9)
            if books:
                scores = np.where(books[0][:, None] == books[1][None, i : i + SLICE], scores, -np.inf)
            order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
            top = np.take_along_axis(scores, order, 1)
            good = np.isfinite(top)
            out.append((np.repeat(names, good.sum(axis=1)), own[order][good], top[good]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    every = _met(queries, vectors, ["book"] * same_book).applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_moments(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per query over all vectors: mean and population deviation of the scores, z of the best and of the best three.

    Sums and the three best are combined per block of queries and part of the vectors; any number of queries."""

    def sums(asked: pa.Table, part: pa.Table) -> pa.Table:
        q, v = _matrix(asked), _matrix(part)
        n = asked.num_rows if part.num_rows else 0
        s, squares, top = np.zeros(n), np.zeros(n), np.full((n, 0), 0.0)
        for i in range(0, part.num_rows if n else 0, SLICE):
            scores = q @ v[i : i + SLICE].T
            s, squares = s + scores.sum(axis=1), squares + (scores * scores).sum(axis=1)
            top = -np.sort(-np.hstack([top, scores]), axis=1)[:, :3]
        return pa.table({
            "query_id": asked["query_id"].slice(0, n), "n": pa.array([part.num_rows] * n, pa.int64()), "s": s, "q": squares,
            "top": pa.array(list(top), pa.list_(pa.float64())),
        })

    part = _met(queries, vectors, []).applyInArrow(sums, "query_id long, n long, s double, q double, top array<double>")
    # three values a part come together
    whole = part.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, 3).alias("top"),
    )
    mean = F.col("s") / F.col("n")
    std = F.greatest(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(1e-9))
    mean3 = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    return whole.select(
        "query_id", F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round((F.col("top")[0] - mean) / std, 4).alias("z1"),
        F.round((mean3 - mean) / std, 4).alias("z3"),
    )


def mean_pool(tokens: DataFrame) -> DataFrame:
    """`(id, v)`: the mean of the unmasked token vectors (id, v, mask) of a text, L2-normalised."""
    parts = tokens.where("mask").select("id", F.posexplode("v").alias("d", "x")).groupBy("id", "d").agg(F.avg("x").alias("x"))
    pooled = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("v"))
    return pooled.select("id", l2_normalise(F.col("v")).alias("v"))


def separation(scores: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Per metric: least score of the good, greatest of the junk, the gap, and half way between them if there is one."""
    good, junk = F.col(label), ~F.col(label)
    long = scores.select(label, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s")).select(label, "s.*")
    out = long.groupBy("metric").agg(F.min(F.when(good, F.col("x"))).alias("min_good"), F.max(F.when(junk, F.col("x"))).alias("max_junk"))
    gap = F.col("min_good") - F.col("max_junk")
    return out.withColumn("gap", gap).withColumn("threshold", F.when(gap > 0, (F.col("min_good") + F.col("max_junk")) / 2))


def paired_gain(pairs: DataFrame) -> DataFrame:
    """(raw, variant, gold): mean gain of variant over raw, and the share of the possible gain that it got (100 if none)."""
    got, possible = F.sum(F.col("variant") - F.col("raw")), F.sum(F.col("gold") - F.col("raw"))
    return pairs.agg(
        F.count("*").alias("n"), F.avg(F.col("variant") - F.col("raw")).alias("mean_gain"),
        F.when(possible <= 0.001, 100.0).otherwise(100 * got / possible).alias("recovered_percent"),
    )
