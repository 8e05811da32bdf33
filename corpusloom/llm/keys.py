"""Row keys and plain helpers that the pipeline operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as the word contract `[^\x20\x09-\x0D]+` has it.
SPACE = r"[\x20\x09-\x0D]"


def doc_key(doc_id: str, text: str) -> Column:
    """The document's id; where it is null, a hash of its text stands in."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Only what an operator needs: `k`, `doc_id`, `text` (null: empty) and `more`; other columns can't clash."""
    return docs.select(
        doc_key(doc_id, text).alias("k"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *more,
    )


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """`row`, a struct of all columns whatever their names, beside the keys to join by; see `rows_back`."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def rows_back(joined: DataFrame) -> DataFrame:
    """The columns of `row` again."""
    return joined.select("row.*")
