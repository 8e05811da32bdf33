"""Model hooks: user-supplied models over Arrow batches, and deterministic stand-ins for tests."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def matches(c: Column | str, regex: str) -> Column:
    """How many matches of a regex (as RE2 has it) a text has, null for null; Spark's regexp_count makes an array of all of them."""
    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pc.count_substring_regex(texts, regex).cast(pa.int32())

    return count(c)


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], dim: int, *, most: int = 2000, least: int = 40) -> DataFrame:
    """`df` with `v`: model(texts) per Arrow batch, text cut to the model's `most` characters (the contract of the hook);
    texts under `least` give null; a vector of another size than dim is an error."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            ok = texts.str.len().fillna(0) >= least
            if ok.any():
                v = np.asarray(model(texts[ok].str.slice(0, most).tolist()), np.float32)
                if v.shape != (int(ok.sum()), dim):
                    raise ValueError(f"the model gave {v.shape}, not {dim} values a text")
                for i, row in zip(np.flatnonzero(ok), v, strict=True):
                    out.iat[i] = row
            yield out

    return df.withColumn("v", run(F.col(text)))


def hashed_embedder(dim: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """Deterministic vectors of hashed character n-grams."""
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for i in range(len(t) - n + 1):
                h = xxhash.xxh3_64_intdigest(t[i : i + n])
                row[h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return run


def rerank(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]], *, batch: int = 20, most: int = 1200) -> DataFrame:
    """pairs (query, text) with `rerank`: the model's scores in input order, `batch` at a time.

    A failed batch scores 0; where all batches of an Arrow batch fail, the model is away and the scores are null."""
    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        out, failed = [], 0
        for i in range(0, len(query), batch):
            q, t = query[i : i + batch].tolist(), text[i : i + batch].str.slice(0, most).tolist()
            try:
                out += [float(s) for s in model(q, t)]
            except Exception:  # noqa: BLE001  whatever a user's model raises
                out += [0.0] * len(q)
                failed += len(q)
        return pd.Series([None] * len(out) if failed == len(out) else out, dtype="float64")

    return pairs.withColumn("rerank", run(F.col("query"), F.col("text")))


def rewrite(df: DataFrame, text: str, model: Callable[[list[str]], list[str]], drift: float = 0.2) -> DataFrame:
    """`df` with `text` rewritten by the model; results whose length differs by more than `drift` are dropped for the original."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        new = pd.Series(model(texts.tolist()), index=texts.index)
        return new.where((new.str.len() - texts.str.len()).abs() <= drift * texts.str.len(), texts)

    return df.withColumn(text, run(F.col(text)))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normalisation form C, for which Spark has no built-in."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))
