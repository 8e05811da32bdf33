"""Greedy packing of text pieces as folds over arrays: one row a document, so documents spread over the cluster."""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ocr import stripped
from .text import Col, _c, strip


def pack(pieces: Column, most: int, glue: str, least: int = 0) -> Column:
    """Join pieces by `glue` while the result has at most `most` characters; results under `least` are dropped."""
    empty = F.array().cast("array<string>")

    def put(out: Column, x: Column) -> Column:
        return F.when(F.length(strip(x)) >= max(1, least), F.concat(out, F.array(strip(x)))).otherwise(out)

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["cur"] == "", x).otherwise(F.concat(acc["cur"], F.lit(glue), x))
        full = (F.length(joined) > most) & (acc["cur"] != "")
        return F.struct(F.when(full, x).otherwise(joined).alias("cur"), F.when(full, put(acc["out"], acc["cur"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit("").alias("cur"), empty.alias("out")), step, lambda acc: put(acc["out"], acc["cur"]))


def paragraphs(c: Col, separator: str = r"\n\n+") -> Column:
    return F.filter(F.transform(F.split(_c(c), separator), strip), lambda x: x != "")


def chunk_text(c: Col, *, most: int = 1500, least: int = 80, separator: str = r"\n\n+") -> Column:
    """Paragraphs packed to `most` characters; what is still longer is cut at sentence ends and packed again."""
    whole = pack(paragraphs(c, separator), most, "\n\n", least)
    return F.flatten(F.transform(whole, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(
        pack(F.split(x, r"(?<=[।.!?\n])\s+"), most, " ", least))))


def chunk_overlap(c: Col, *, size: int = 1800, overlap: int = 200, separator: str = r"\n\n+") -> Column:
    """Paragraphs over 40 characters, packed to `size`, each chunk opening with the end of the one before; a paragraph
    over `size` is packed by its sentences, without overlap.

    Over Arrow batches: a fold of columns works every branch's value out anew wherever it is used."""
    apart, sentence = re.compile(separator), re.compile("[^.!?]+[.!?]+")

    def chunks(text: str) -> list[str]:
        out, cur = [], ""
        for x in map(stripped, apart.split(text)):
            if len(x) <= 40:
                continue
            if cur and len(cur) + 2 + len(x) > size:
                out.append(stripped(cur))
                cur = (cur[-overlap:] if overlap else "") + "\n\n" + x
            elif len(x) > size:
                # no sentence ends behind the last mark: from each place there the pattern would run to the end of the text
                ended = x[: max(map(x.rfind, ".!?")) + 1]
                for s in sentence.findall(ended) or [x]:
                    if cur and len(cur) + 1 + len(s) > size:
                        out.append(stripped(cur))
                        cur = s
                    else:
                        cur = f"{cur} {s}" if cur else s
            else:
                cur = f"{cur}\n\n{x}" if cur else x
        return out + [stripped(cur)] if stripped(cur) else out

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(_c(c))


def pack_paragraphs(c: Col, *, most: int = 5000, cap: int = 30_000, separator: str = r"\n\n+") -> Column:
    """Windows of whole paragraphs; `cap` is the feature's own limit of input."""
    return pack(F.filter(F.split(F.substring(_c(c), 1, cap), separator), lambda x: x != ""), most, "\n\n")
