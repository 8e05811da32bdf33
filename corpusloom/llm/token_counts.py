"""Token counts (2): unigram segmentation of distinct pre-tokens, by dynamic programming shared along a trie.

A task inserts the distinct pre-tokens (blank-separated words, a word mark before each) of a batch into a trie, here as
their sorted list: what a word shares with the one before it are the trie nodes they share. The forward score of a node,
the best sum of piece scores for the characters up to it, is computed once and kept on a stack while words below it are
visited; a word's own count is stored when it ends. Texts then sum the stored counts. No shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .keys import texts

MARK = "▁"


class Pieces:
    """Vocabulary pieces with log scores, as a trie of dicts; key "" of a node holds the score of the piece it ends."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): -float(np.log(rank + 2.0)) for rank, i in enumerate(ids)}
        self.per_byte = 2 * min(self.scores.values())
        self.root: dict = {}
        for piece, score in self.scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def count_words(words: list[str], vocabulary: Pieces) -> dict[str, int]:
    """Tokens of each word (marked) in its best segmentation; of equal scores the one with fewer tokens."""
    counts = {}
    root, per_byte = vocabulary.root, vocabulary.per_byte
    # per depth: best score, its token count, and the vocabulary nodes of pieces that are still being read. The stack
    # holds the nodes that the next word shares: a long word leaves no more behind than that
    stack = [(0.0, 0, [(root, 0.0, 0)])]
    ordered, shared = sorted(words), 0
    for word, after in zip(ordered, [*ordered, ""][1:], strict=True):
        keep, most = 0, min(len(word), len(after))
        while keep < most and word[keep] == after[keep]:
            keep += 1
        del stack[shared + 1 :]
        score, tokens, active = stack[shared]
        for at in range(shared, len(word)):
            c = word[at]
            n = len(c.encode("utf-8", "surrogatepass"))
            best, fewest = score + per_byte * n, tokens + n  # byte fallback
            going = []
            for node, s, t in active:
                node = node.get(c)
                if node is None:
                    continue
                going.append((node, s, t))
                own = node.get("")
                if own is not None and (s + own > best or s + own == best and t < fewest):
                    best, fewest = s + own, t + 1
            going.append((root, best, fewest))
            score, tokens, active = best, fewest, going
            if at < keep:
                stack.append((score, tokens, active))
        counts[word] = tokens
        shared = keep
    return counts


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str = "", cache: int = 300_000) -> DataFrame:
    """`k, doc_id, n_chars, n_words, n_tokens` for every row.

    Pieces are those of a public vocabulary; a piece's log score is minus the log of its rank plus 2 (ranks are by merge
    order there, so by falling frequency: Zipf's law). A character in no piece counts its UTF-8 bytes. Words are what
    str.split() gives, a word mark before each. Null and blank texts have 0 tokens. Very long texts and words are counted
    whole. Of segmentations that tie, the one with fewer tokens counts. Repeated rows are counted each. An empty table
    gives no rows; other columns are ignored, whatever their names.
    `cache` bounds the counts that a task remembers between batches.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = pieces(path), {}
        for batch in batches:
            split = [x.split() for x in batch.column(2).to_pylist()]
            fresh = set()
            for w in split:
                fresh.update(w)
            fresh.difference_update(known)
            known |= {w[1:]: n for w, n in count_words([MARK + w for w in fresh], vocabulary).items()}
            out = [[len(x) for x in batch.column(2).to_pylist()], [len(w) for w in split], [sum(map(known.__getitem__, w)) for w in split]]
            if len(known) > cache:
                known = {}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in out)], ["k", "doc_id", "n_chars", "n_words", "n_tokens"]
            )

    return texts(docs, doc_id, text).mapInArrow(rows, "k long, doc_id long, n_chars long, n_words long, n_tokens long")
