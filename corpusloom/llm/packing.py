"""Packing (7): sum-of-squares online packing of token sequences into windows of bounded length.

Each task packs the documents of its partition in order. A level array counts the partly filled windows at every fill
level; a document goes to the level (0 opens a window) that leaves the sum of squared counts smallest, which steers the
windows towards completion. A document over the capacity first fills whole windows. When a task's rows end, its open
windows are completed from one another by cutting, and the last remainder is cut into powers of two, so nothing is
padded. Windows never span tasks: no shuffle, and a lost task is redone alike from its own rows.
"""
from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from .keys import texts

_CACHES: dict[str, ChunkIds] = {}
#: With these rules a tokenizer drops case and white space, lets no token cross white space, and takes a run
#: of letters and the marks behind it apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Letters whose lower case is one letter and which no normal form changes, and marks behind them: two of its words.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|>()\"-]*)")
RUN = 100_000  # characters that are tokenised at once, a whole chunk at least


def chunk_ids(path: str) -> ChunkIds:
    """One cache a Python worker, kept from task to task."""
    if path not in _CACHES:
        _CACHES[path] = ChunkIds(path)
    return _CACHES[path]


class ChunkIds:
    """Ids of texts as little-endian uint32 bytes, put together from those of their blank-separated chunks.

    Chunks that the cache doesn't hold are tokenised together, each once. The cache has two generations of at most
    `limit` chunks: when the newer one is full, the older one goes. A tokenizer with other rules than the ones above gets
    whole texts.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers")
        self.by_chunk = (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS and steps == [SPLIT, BYTES]
        self.model = self.tokenizer.model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {x: shown.pre_tokenize_str(chr(x))[0][0] for x in range(0xDF, 0x100) if chr(x).isalpha()}
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*cut).difference(self.new))
        get = self.new.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {"": b""}
        return out

    def _learn(self, chunks: set[str]) -> None:
        rest = []
        for chunk in chunks:
            ids = self.old.get(chunk)
            if ids is None:
                word = PLAIN.fullmatch(chunk)
                if word is None:
                    rest.append(chunk)
                    continue
                ids = self._letters(word[1].lower())
                if word[2]:
                    ids += self._marks(word[2])
            self.new[chunk] = ids
        self._tokenise(rest)

    def _letters(self, word: str) -> bytes:
        """Ids of a word that PLAIN takes: by the model alone, in its own alphabet, without the rules before it."""
        ids = self.new.get(word) or self.old.get(word)
        if ids is None:
            tokens = self.model.tokenize(word.translate(self.letters))
            ids = struct.pack(f"<{len(tokens)}I", *[x.id for x in tokens])
        self.new[word] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        ids = self.new.get(marks) or self.old.get(marks)
        if ids is None:
            self._tokenise([marks])
            return self.new[marks]
        return ids

    def _tokenise(self, parts: list[str]) -> None:
        run, size = [], 0
        for i, part in enumerate(parts):
            run.append(part)
            size += len(part) + 1
            if size >= RUN or i + 1 == len(parts):
                found = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
                ids = np.array(found.ids, "<u4").tobytes()
                # where each part begins in the run, and the first token from there on
                begins = np.cumsum([0, *[len(x) + 1 for x in run]])
                at = 4 * np.searchsorted(np.array([x for x, _ in found.offsets], np.int64), begins)
                self.new.update((x, ids[a:b]) for x, a, b in zip(run, at[:-1].tolist(), at[1:].tolist(), strict=True))
                run, size = [], 0


class LevelPacker:
    """Windows of `capacity`; a piece is any tuple whose last item is its length. `done` windows are lists of pieces."""

    def __init__(self, capacity: int, most: int = 4096):
        self.capacity, self.most, self.n_open = capacity, most, 0
        self.count = np.zeros(capacity + 1)  # open windows at each level
        # with these two constants one formula covers opening a window and completing one
        self.count[0], self.count[capacity] = 0.5, -0.5
        self.open: dict[int, list[list[tuple]]] = {}
        self.done: list[list[tuple]] = []

    def place(self, piece: tuple) -> None:
        """Put a piece no longer than a window where the squares of the counts grow least; of ties, the fullest."""
        size = piece[-1]
        levels = np.flatnonzero(self.count[: self.capacity - size + 1] > 0)[::-1]
        level = int(levels[np.argmin(self.count[levels + size] - self.count[levels])])
        window = [] if level == 0 else self.open[level].pop()
        if level:
            self.count[level] -= 1
        self.n_open -= level > 0
        window.append(piece)
        self._keep(window, level + size)

    def _keep(self, window: list[tuple], level: int) -> None:
        if level == self.capacity:
            self.done.append(window)
        elif level:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
            self.n_open += 1

    def close(self, cut) -> None:
        """Complete open windows from the emptiest ones, down to one; `cut(piece, n)` gives the first n and the rest."""
        left = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[1 : self.capacity] = 0
        spare: list[tuple] = []
        while left:
            level, window = left.pop()
            while level < self.capacity and (spare or left):
                if not spare:
                    spare = left.pop(0)[1]
                piece = spare.pop()
                if piece[-1] > self.capacity - level:
                    piece, rest = cut(piece, self.capacity - level)
                    spare.append(rest)
                window.append(piece)
                level += piece[-1]
            if level == self.capacity:
                self.done.append(window)
            else:
                spare = window  # the last one
        self._keep(spare, sum(p[-1] for p in spare))

    def finish(self, cut) -> None:
        """Complete all windows; what the last one holds is cut into powers of two."""
        self.close(cut)
        spare = [p for windows in self.open.values() for w in windows for p in w]
        self.open, self.n_open = {}, 0
        size = self.capacity
        total = sum(p[-1] for p in spare)
        while total:
            size //= 2
            if total & size:
                window, room = [], size
                while room:
                    piece = spare.pop(0)
                    if piece[-1] > room:
                        piece, rest = cut(piece, room)
                        spare.insert(0, rest)
                    window.append(piece)
                    room -= piece[-1]
                self.done.append(window)
                total -= size


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "", capacity: int = 4096, end_id: int = 2,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset` and, with_ids, `ids`.

    A document's ids are the tokenizer's (no special tokens added) and then end_id, so a null, empty or blank text is
    the one id end_id. `capacity` is a power of two. Repeated rows are packed each on its own; a null doc_id stays null.
    Of levels that tie, the fullest is filled. Sequences are full, or, at the end of a task, a power of two: no padding.
    Other columns are ignored, whatever their names; an empty table gives no pieces. Texts are tokenised whole, very long
    ones too; memory holds one batch, a bounded cache and the open windows, each with its own ids only: when they are
    more than a bound, they are completed by cutting at once.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    names = NAMES if with_ids else NAMES[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = chunk_ids(path), LevelPacker(capacity)
        sequence = (TaskContext.get().partitionId()) << 40
        # a piece: doc_id, start, tokens of the document, the piece's ids as bytes, length
        cut = lambda p, n: ((*p[:3], p[3][: 4 * n], n), (p[0], p[1] + n, p[2], p[3][4 * n :], p[4] - n))

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in NAMES]
            for window in packer.done:
                offset = 0
                for doc, start, tokens, ids, length in window:
                    for column, value in zip(out, (doc, start, length, zlib.crc32(ids), tokens, sequence, offset, ids), strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            packer.done.clear()
            columns = [*(pa.array(x, pa.int64()) for x in out[:-1]), *([pa.array(out[-1], pa.binary())] if with_ids else [])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for doc, ids in zip(part.column(0).to_pylist(), cache.of(part.column(1).to_pylist()), strict=True):
                    ids += end
                    tokens, start = len(ids) // 4, 0
                    while tokens - start >= capacity:
                        packer.done.append([(doc, start, tokens, ids[4 * start : 4 * (start + capacity)], capacity)])
                        start += capacity
                    if start < tokens:
                        packer.place((doc, start, tokens, ids[4 * start :], tokens - start))
                    if packer.n_open > packer.most:
                        packer.close(cut)
                yield flush()
        packer.finish(cut)
        yield flush()

    schema = ", ".join(f"{x} long" for x in NAMES[:-1]) + (", ids binary" if with_ids else "")
    return texts(docs, doc_id, text).select("doc_id", "text").mapInArrow(rows, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
