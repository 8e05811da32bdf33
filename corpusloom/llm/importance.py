"""Target-distribution importance resampling (13): word n-grams hashed into buckets, by prefix CRCs.

A document's words, joined by one blank, are scanned once: zlib gives the running CRC behind every word. The CRC of the
n-gram from word i to word j is then that behind j, less that before i shifted by the n-gram's length; the shift (so many
zero bytes) is linear over GF(2), so it is four lookups in a table of its length, for all n-grams of a batch at once. No
n-gram is ever built as a string.

Counts per bucket are summed in each task and then over tasks: at most BUCKETS numbers a task. Log ratios of the target's
and the corpus' counts are the buckets' gains; a document's weight is the sum over its n-grams, and Gumbel noise makes
the highest scores a draw without replacement. The draw's ranks come from range partitions (operators.ranks).
"""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ordered
from ..session import Scratch, cut
from .keys import texts

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
#: Lower-cases A-Z and makes blanks of all ASCII that is no letter or digit.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+ ")
#: Shifts up to so many bytes have a table each; longer ones are put together from powers of two.
SHORT = 192
#: Words whose n-grams are hashed at once.
BATCH = 200_000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))  # the polynomial of zlib's CRC
    return table


STEP = _crc_table()
_BACK = np.argsort(STEP >> 24)  # the top byte tells which entry was used


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return STEP[c & 0xFF] ^ (c >> 8)


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables (length, byte of the CRC, its value) of shifts by 0 to SHORT - 1 bytes, and by the powers of two."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    small = [one]
    for _ in range(SHORT - 1):
        small.append(_zero_byte(small[-1]))
    powers = [small[1]]
    for _ in range(40):
        powers.append(_shifted(powers[-1], powers[-1]))
    return np.array(small), np.array(powers)


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


SMALL, POWERS = _shifts()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by `length` bytes each."""
    flat, at = SMALL.reshape(-1), np.minimum(length, SHORT - 1) * 1024
    out = flat[at + (crc & 0xFF)] ^ flat[at + 256 + ((crc >> 8) & 0xFF)] ^ flat[at + 512 + ((crc >> 16) & 0xFF)] ^ flat[at + 768 + (crc >> 24)]
    long = np.flatnonzero(length >= SHORT)
    if len(long):
        own, left = crc[long], length[long]
        for k in range(int(left.max()).bit_length()):
            own = np.where((left >> k) & 1, _shifted(own, POWERS[k]), own)
        out[long] = own
    return out


def running_crcs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a text: the CRC before it and behind it, and its start and end, in the words joined by one blank."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").translate(PLAIN).split()) + b" "
    end = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(data) == 1:
        end = end[:0]
    crc = zlib.crc32
    words = (m.group() for m in _WORD.finditer(data)) if len(data) > 1 << 22 else _WORD.findall(data)
    met = np.fromiter(accumulate(words, lambda c, w: crc(w, c), initial=0), np.uint32, len(end) + 1)
    # each word was taken with the blank behind it: one step back
    raw = ~met[1:]
    used = _BACK[raw >> 24].astype(np.uint32)
    behind = ~(((raw ^ STEP[used]) << 8) | (used ^ np.uint32(32)))
    return met[:-1], behind, np.append(0, end[:-1] + 1)[: len(end)], end


def buckets(found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document's place in the list, bucket) of all n-grams, one pair of arrays for each length."""
    sizes = [len(x[0]) for x in found]
    before, behind, start, end = (np.concatenate([x[i] for x in found]) for i in range(4))
    doc = np.repeat(np.arange(len(found)), sizes)
    for n in range(1, LONGEST + 1):
        i = np.arange(max(0, len(doc) - n + 1))
        i = i[doc[i] == doc[i + n - 1]]
        j = i + n - 1
        yield doc[i], (behind[j] ^ shift(before[i], end[j] - start[i])) % BUCKETS


def _grouped(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of (row, running CRCs) of about BATCH words."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += len(item[1][0])
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def bucket_counts(rows: DataFrame, least_words: int = 0) -> tuple[np.ndarray, int]:
    """How many n-grams of the `text` of all rows each bucket has, and how many rows have `least_words` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, long = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for held in _grouped((None, running_crcs(t.as_py())) for t in batch.column(0)):
                long += sum(len(x[0]) >= least_words for _, x in held)
                for _, b in buckets([x for _, x in held]):
                    total += np.bincount(b, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([long, *total[at].tolist()], pa.int64())], ["bucket", "n"])

    met = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, np.int64)  # BUCKETS rows and one: a fixed size
    long = 0
    for r in met:
        if r["bucket"] < 0:
            long = r["n"]
        else:
            total[r["bucket"]] = r["n"]
    return total, long


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of the log ratio of smoothed shares, rounded down."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    least_words: int = 20, percent: int = 5, seed: int = 42,
) -> DataFrame:
    """`doc_id, n_features, weight, score, rank` for every row; rank is null where the row isn't drawn.

    `percent` of the rows with at least `least_words` words are drawn, rounded down: those of highest score, ties to the
    smaller doc_id. Null, empty and wordless texts have no n-grams and weight 0; very long ones are scanned whole. Rows
    that repeat are judged each (equal ids have equal noise, and of rows that tie in score and id either may go first).
    A null doc_id has the noise of the empty string and comes first among ties. An empty target leaves the gains to the
    corpus alone; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = texts(docs, doc_id, text)
    corpus, long = bucket_counts(rows, least_words)
    wanted, _ = bucket_counts(target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(gains(corpus, wanted))  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)  # sums stay whole below 2^53
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for held in _grouped((i, running_crcs(t.as_py())) for i, t in zip(ids, batch.column(1), strict=True)):
                own = [i for i, _ in held]
                words = np.array([len(x[0]) for _, x in held])
                weight, features = np.zeros(len(held)), np.zeros(len(held), np.int64)
                for doc, b in buckets([x for _, x in held]):
                    weight += np.bincount(doc, gain[b], len(held))
                    features += np.bincount(doc, minlength=len(held))
                weight = weight.astype(np.int64)
                score = weight + np.array([gumbel(i, seed) for i in own], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(features), pa.array(weight), pa.array(score), pa.array(words >= least_words)],
                    ["doc_id", "n_features", "weight", "score", "long"],
                )

    with Scratch(docs.sparkSession) as scratch:
        found = scratch.staged(rows.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, long boolean"))
        placed = ordered(found.where("long"), F.desc("score"), F.asc_nulls_first("doc_id"), scratch=scratch)
        drawn = F.when(F.col("row") < percent * long // 100, F.col("row") + 1)
        every = placed.withColumn("rank", drawn).drop("row").unionByName(found.where("not long").withColumn("rank", F.lit(None).cast("long")))
        return cut(every.drop("long"))
