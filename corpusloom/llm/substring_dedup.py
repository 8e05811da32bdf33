"""Suffix-array dedup (11) by prefix-free parsing: bytes of every repeated string of `depth` bytes go but for the first.

Parse: a rolling hash over half of `depth` bytes sets the triggers: those places whose hash is least among all that lie in
one string of `depth` bytes. What all strings with the same trigger span is a phrase; a document is a sequence of phrases.
Which trigger a string has depends on its own bytes alone, and no phrase is longer than a trigger allows, so equal strings
lie at equal places behind or before equal triggers, wherever they occur.

Only order by the first `depth` bytes matters here, so the two suffix arrays are cut at that depth:

1. The parse, in the order of its phrases (trigger, then the whole phrase, then document and place): all but the first
   of equal phrases repeat it from start to end. They are settled without looking at a byte of them, so highly repetitive
   text costs a row for each phrase. Copies within a batch are settled before the shuffle, in spans.
2. The dictionary, the first of each phrase. A phrase alone at its trigger shares no string with any other. Of the rest
   the suffixes are sorted by their bytes (the suffix array of that part of the dictionary), ties by document and place; a
   suffix equal to the one before it repeats it.

Then each document's spans are joined to it and cut out. Hashes bring equal phrases together (128 bits of two functions);
strings of different phrases are compared byte by byte.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut
from .keys import texts
from .shingles import mix

#: Places of a batch that is parsed at once, in the low bits of a hash when the least one is looked for.
PLACES = np.uint64((1 << 23) - 1)
PIECE = 1 << 21  # bytes of a batch; longer documents are parsed in pieces
#: Odd multipliers of the two rolling hashes, and what tells bytes apart in them.
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
BYTES = np.array([mix(np.arange(1, 257, dtype=np.uint64) * b) for b in BASES])
#: `at` holds 13 bits of the text's hash (documents that share an id), 42 of the place and 8 of the number of strings.
SPAN = 255  # instead of a number: a span that is settled, its length stands in c

#: Phrases of a trigger that one task sorts; the strings of more are sorted by range partitions.
LARGE = 4096


class Powers:
    """Powers of the bases and of their inverses modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones((2, 1), np.uint64)

    def grow(self, n: int) -> None:
        if n <= self.up.shape[1]:
            return
        inverse = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
        self.up, self.down = (
            np.multiply.accumulate(np.hstack([np.ones((2, 1), np.uint64), np.broadcast_to(x[:, None], (2, n))]), axis=1) for x in (BASES, inverse)
        )


def _rolling(raw: np.ndarray, powers: Powers, which: int) -> np.ndarray:
    """Sums from which the hash of any stretch follows: (sum behind it - sum before it) * power of its start."""
    powers.grow(len(raw))
    return np.append(np.uint64(0), np.cumsum(BYTES[which][raw] * powers.down[which, : len(raw)], dtype=np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys side by side."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def phrases(raw: np.ndarray, bounds: np.ndarray, depth: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """For each phrase of the texts between bounds in raw: text, first place, number of strings, trigger hash, phrase hash."""
    none = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < depth:
        return none
    gram = depth // 2
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(doc[: len(doc) - depth + 1] == doc[depth - 1 :])
    if not len(start):
        return none
    sums = _rolling(raw, powers, 0)
    grams = mix((sums[gram:] - sums[:-gram]) * powers.up[0, : len(raw) - gram + 1])
    keys = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_least(keys, depth - gram + 1)[start] & PLACES).astype(np.int64)
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    a, t = start[first], trigger[first]
    sums = _rolling(raw, powers, 1)
    whole = (sums[a + n - 1 + depth] - sums[a]) * powers.up[1, a]
    shape = (n * 256 + (t - a)).astype(np.uint64)  # how long it is, and where in it the trigger lies
    return doc[a], a - bounds[doc[a]], n, grams[t], mix(whole + shape * BASES[1])


def _pieces(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray, np.ndarray]]:
    """(k, hash of the text, place of the piece in it, bytes, bounds) of some PIECE bytes of texts at a time."""
    keys, marks, offsets, held, size = [], [], [], [], 0
    for k, x, text in zip(*(batch.column(i) for i in range(3)), strict=True):
        data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, max(1, len(data) - depth + 1), PIECE):
            part = data[at : at + PIECE + depth - 1]
            if size + len(part) > PIECE + depth and held:
                yield keys, marks, offsets, np.concatenate(held), np.append(0, np.cumsum([len(h) for h in held]))
                keys, marks, offsets, held, size = [], [], [], [], 0
            keys.append(k.as_py())
            marks.append(x.as_py())
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield keys, marks, offsets, np.concatenate(held), np.append(0, np.cumsum([len(h) for h in held]))


def _batch(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], kind.split())


def _parsed(rows: DataFrame, depth: int) -> DataFrame:
    """`h, c, k, at`: a row for each phrase, or for a span of such as repeat earlier phrases of the same batch."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for keys, marks, offsets, raw, bounds in _pieces(batch, depth):
                doc, place, n, h, c = phrases(raw, bounds, depth, powers)
                k, mark, offset = (np.array(x, np.int64)[doc] for x in (keys, marks, offsets))
                at = (mark << 50) | ((place + offset) << 8)
                order = np.lexsort((at, k, c, h))
                again = np.zeros(len(order), bool)
                same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
                same &= (k[order][1:] != k[order][:-1]) | (at[order][1:] != at[order][:-1])
                again[order[1:]] = same
                yield _batch("h c k at", h[~again], c[~again], k[~again], at[~again] | n[~again])
                # settled phrases that follow each other are one span
                own = np.flatnonzero(again)
                if len(own):
                    new = np.append(True, (np.diff(own) > 1) | (np.diff(doc[own]) > 0))
                    first = own[new]
                    length = np.add.reduceat(n[own], np.flatnonzero(new))
                    yield _batch("h c k at", mix((k[first] ^ at[first]).view(np.uint64)), length, k[first], at[first] | SPAN)

    return rows.select("k", "x", "text").mapInArrow(parse, "h long, c long, k long, at long")


def _parse_order(parsed: DataFrame) -> DataFrame:
    """`h, k, x, place, n, contested`: of the parse in its order, what repeats the phrase before it (contested false), and
    the first phrases at a trigger that has several (true)."""
    names = "h k x place n contested"

    def rows(h, k, at, n, contested: bool) -> pa.RecordBatch:
        return _batch(names, h, k, at >> 50, (at >> 8) & ((1 << 42) - 1), n, np.full(len(k), contested))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, several = None, False  # the phrase that was first, and whether its trigger had another one before
        before = None  # the row before
        for batch in batches:
            h, c, k, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            span = (at & 255) == SPAN
            if span.any():
                yield rows(h[span], k[span], at[span], c[span], False)
                h, c, k, at = (x[~span] for x in (h, c, k, at))
            if not len(h):
                continue
            # the first phrase of what came before stands in front, until it is known whether others share its trigger
            table = np.stack([h, c, k, at])
            if last is not None:
                table = np.hstack([last[:, None], table])
            new = np.append(True, (table[:2, 1:] != table[:2, :-1]).any(axis=0))
            earlier = table[:, :-1].copy()
            if last is not None:
                earlier[:, 0] = before
            repeated = np.append(False, (table[:, 1:] == earlier).all(axis=0))  # the same place of a document that is there twice
            gone = table[:, ~new & ~repeated]
            yield rows(gone[0], gone[2], gone[3], gone[3] & 255, False)
            first = table[:, new]
            together = first[0, 1:] == first[0, :-1]
            contested = np.append(several, together) | np.append(together, False)
            out = first[:, :-1][:, contested[:-1]]
            yield rows(out[0], out[2], out[3], out[3] & 255, True)
            last, several, before = first[:, -1], bool(contested[-1]), table[:, -1]
        if last is not None and several:
            yield rows(last[0:1], last[2:3], last[3:4], last[3:4] & 255, True)

    ordered = parsed.repartition("h").sortWithinPartitions("h", "c", "k", "at")
    return ordered.mapInArrow(walk, "h long, k long, x long, place long, n long, contested boolean")


def _contested_phrases(rows: DataFrame, contested: DataFrame, depth: int, large: int) -> DataFrame:
    """`h, k, x, place, n, phrase, large`: contested phrases with their bytes, and whether their trigger has more than `large`."""
    many = contested.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > large).select("h", F.lit(True).alias("large"))
    flagged = contested.join(many, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = flagged.groupBy("k", "x").agg(F.collect_list(F.struct("h", "place", "n", "large")).alias("own"))
    met = rows.join(wanted.hint("merge"), ["k", "x"]).select("k", "x", "text", "own")

    def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x, text, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                h, place, n, flags = (own.values.field(i) for i in range(4))
                found = [data[i : i + m - 1 + depth] for i, m in zip(place.to_pylist(), n.to_pylist(), strict=True)]
                same = [pa.array([v.as_py()] * len(found), pa.int64()) for v in (k, x)]
                yield pa.RecordBatch.from_arrays([h, *same, place, n, pa.array(found, pa.binary()), flags], "h k x place n phrase large".split())

    return met.mapInArrow(phrases_of, "h long, k long, x long, place long, n long, phrase binary, large boolean")


def _dictionary_order(phrases: DataFrame, depth: int) -> DataFrame:
    """`k, x, place, n`: the strings of contested phrases that equal an earlier one.

    The phrases of a trigger meet in one task, which sorts all their suffixes; only strings with the same trigger can be
    equal. Triggers with very many phrases send their strings to range partitions of the strings instead."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def suffix_array(held: list[tuple]) -> pa.RecordBatch:
            """Rows come by trigger, then document and place; of equal suffixes that is the order they keep."""
            strings = np.array([p[i : i + depth] for _, _, _, _, n, p in held for i in range(n)], f"S{depth}")
            order = np.argsort(strings, kind="stable")
            again = np.zeros(len(order), bool)
            again[order[1:]] = strings[order][1:] == strings[order][:-1]
            n = np.array([r[4] for r in held])
            k, x, place = (np.repeat(np.array([r[i] for r in held]), n) for i in (1, 2, 3))
            place = place + np.arange(len(place)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
            return _batch("k x place n", k[again], x[again], place[again], np.ones(again.sum(), np.int64))

        held, size, now = [], 0, (None,) * 4
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != now[0] and size > 50_000:
                    yield suffix_array(held)
                    held, size = [], 0
                if row[:4] == now:  # of a document that is there twice
                    continue
                now = row[:4]
                held.append(row)
                size += row[4]
        if held:
            yield suffix_array(held)

    few = phrases.where("not large").drop("large").repartition("h").sortWithinPartitions("h", "k", "x", "place")
    few = few.mapInArrow(together, "k long, x long, place long, n long")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x, place, n, phrase in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                own = [phrase[i : i + depth] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *(pa.array(v, pa.int64()) for v in ([k] * n, [x] * n, range(place, place + n)))], "suffix k x place".split())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None,) * 4
        for batch in batches:
            found = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            again = np.fromiter((a[0] == b[0] and a != b for a, b in zip([last, *found[:-1]], found, strict=True)), bool, len(found))
            last = found[-1] if found else last
            k, x, place = (batch.column(i).to_numpy()[again] for i in (1, 2, 3))
            yield _batch("k x place n", k, x, place, np.ones(len(k), np.int64))

    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = phrases.where("large").mapInArrow(suffixes, "suffix binary, k long, x long, place long")
    many = many.repartitionByRange(parts, "suffix").sortWithinPartitions("suffix", "k", "x", "place")
    return few.unionByName(many.mapInArrow(walk, "k long, x long, place long, n long"))


def removed_bytes(size: int, place: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under the strings that start at the n places from each place."""
    order = np.argsort(place, kind="stable")
    start, end = place[order], np.minimum(np.maximum.accumulate((place + n - 1 + depth)[order]), size)
    new = np.append(True, start[1:] > end[:-1])
    return start[new], np.append(end[:-1][new[1:]], end[-1:])


def repeated_spans(docs: DataFrame, *, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", depth: int = 100, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The rows (k, doc_id, text, x) and `(k, x, spans)`: where the strings start that occur earlier, as (place, n)."""
    rows = texts(docs, doc_id, text)
    rows = rows.withColumn("x", F.pmod(F.xxhash64("text"), F.lit(1 << 13)))
    met = scratch.staged(_parse_order(_parsed(rows, depth)))
    phrases = scratch.staged(_contested_phrases(rows, met.where("contested").drop("contested"), depth, large))
    more = scratch.staged(_dictionary_order(phrases, depth))
    scratch.drop(phrases)
    every = met.where("not contested").select("k", "x", "place", "n").unionByName(more)
    return rows, every.groupBy("k", "x").agg(F.collect_list(F.struct("place", "n")).alias("spans"))


def _cut_out(rows: DataFrame, spans: DataFrame, depth: int, schema: str, make) -> DataFrame:
    """A row for each of `rows`, made from k, doc_id, the text's bytes and the starts and ends of what goes."""
    both = rows.join(spans.hint("merge"), ["k", "x"], "left").select("k", "doc_id", "text", "spans")

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split() for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            out = []
            for k, i, t, spans in zip(*(batch.column(j) for j in range(4)), strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                start = end = np.zeros(0, np.int64)
                if spans.is_valid:
                    start, end = removed_bytes(len(data), *(spans.values.field(j).to_numpy() for j in range(2)), depth)
                out.append(make(k.as_py(), i.as_py(), data, start.tolist(), end.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[kind]) for j, (_, kind) in enumerate(columns)], [n for n, _ in columns])

    return both.mapInArrow(cut_rows, schema)


def _left(data: bytes, start: list[int], end: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *end], [*start, len(data)], strict=True))


def substring_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = 100, large: int = LARGE) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` for every row: the bytes under strings of `depth` bytes that also
    start earlier (at a smaller doc_id, or before in the same document) go; strings are those of the input.

    Matches never cross documents; texts are UTF-8. A null text is empty, and texts under `depth` bytes lose nothing. Very long texts are
    parsed in pieces that overlap, so nothing is missed between them. Rows that repeat id and text are one document: they
    lose the same. Rows that share an id alone are told apart by a hash of the text, which then orders them; a null id is
    replaced by such a hash. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    def made(k: int, i: int | None, data: bytes, start: list[int], end: list[int]) -> tuple:
        return i, len(data), sum(end) - sum(start), len(start), hashlib.sha256(_left(data, start, end)).hexdigest()

    with Scratch(docs.sparkSession) as scratch:
        rows, spans = repeated_spans(docs, scratch=scratch, doc_id=doc_id, text=text, depth=depth, large=large)
        return cut(_cut_out(rows, spans, depth, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", made))


def drop_repeated_substrings(docs: DataFrame, *, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", depth: int = 100) -> DataFrame:
    """`doc_id, text` of every row with the repeated bytes taken out; see substring_report. A character of which a byte is
    left over is dropped. The result reads tables of `scratch`."""
    def made(k: int, i: int | None, data: bytes, start: list[int], end: list[int]) -> tuple:
        return i, _left(data, start, end).decode("utf-8", "ignore")

    rows, spans = repeated_spans(docs, scratch=scratch, doc_id=doc_id, text=text, depth=depth)
    return _cut_out(rows, spans, depth, "doc_id long, text string", made)
