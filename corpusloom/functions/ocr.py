"""Scan noise: tokens and lines of OCR text, judged over Arrow batches.

Column functions judged each token by several patterns, interpreted and over again wherever a value was used. Here a
word is judged once and looked up after that, as a corpus has few different words."""
from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Col, _c

#: White space as Java's patterns have it, and what else their $ takes for the end of a line.
BLANK, ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")
#: Different words of which the verdicts are kept; with more of them it begins anew.
KNOWN = 1 << 18

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_DEVA, _LATIN, _NOT_DEVA = re.compile("[ऀ-ॿ]"), re.compile("[a-zA-Z]"), re.compile("[^ऀ-ॿ]+")
_MARKS = re.compile("[0-9।॥()\\[\\]{}\\-–—.,;:!?'\"]+[\x85\u2028\u2029]?")
_AROUND = re.compile("[.,!?;:'\"()\\[\\]\\-–—|]+")
_RUN, _VOWEL = re.compile("([^\n\r\x85\u2028\u2029])\\1\\1\\1"), re.compile("[aeiouAEIOU]")
_NUMBERS = re.compile("[0-9 \t\n\x0b\f\r।॥()\\[\\]\\-]+[\x85\u2028\u2029]?")
_PLAIN = re.compile("[a-zA-Zऀ-ॿ \t\n\x0b\f\r.,!?;:\\-'\"/0-9()\\[\\]]+")
_GAPS = re.compile("\n{3,}")


def stripped(t: str) -> str:
    """As text.strip, whose pattern also takes blanks before a last end of line."""
    return t[:-1].strip(BLANK) + t[-1] if t.endswith(ENDS) else t.strip(BLANK)


class _Verdicts(dict):
    """A function of words that remembers what it gave."""

    def __init__(self, judge: Callable[[str], bool]):
        self.judge = judge

    def __missing__(self, word: str) -> bool:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = self.judge(word)
        return found


def _stays(token: str) -> bool:
    """Whether a token of a line without Devanagari is none of Latin junk."""
    t = _AROUND.sub("", token)
    junk = _RUN.search(t) or len(t) >= 2 and not _VOWEL.search(t) or len(t) > 16
    return not (junk and _LATIN.search(t))


def _is_mine(token: str) -> bool:
    return bool(_DEVA.search(token) and not _LATIN.search(token) or _MARKS.fullmatch(token))


_stay, _mine = _Verdicts(_stays), _Verdicts(_is_mine)


def _clean_line(line: str) -> str:
    """The tokens of a stripped line that aren't scan noise; nothing for a line of fragments."""
    tokens = _WORD.findall(line)
    if line.isascii() or not _DEVA.search(line):
        return " ".join([t for t in tokens if _stay[t]])
    mine = [t for t in tokens if _mine[t]]
    sizes = [len(_NOT_DEVA.sub("", t)) for t in mine if _DEVA.search(t)]
    broken = len(sizes) >= 3 and max(sizes) < 4 and sum(n <= 2 for n in sizes) / len(sizes) > 0.6
    return "" if broken else " ".join(mine)


def _tokens(text: str) -> str:
    out = []
    for raw in map(stripped, text.split("\n")):
        new = _clean_line(raw)
        if new or not raw:
            out.append(new)
    return stripped(_GAPS.sub("\n\n", "\n".join(out)))


def _shown(line: str) -> bool:
    s = stripped(line)
    total = len(s) - sum(map(s.count, BLANK))
    if total < 25 or _NUMBERS.fullmatch(s) or len(_PLAIN.sub("", s)) / total < 0.12:
        return True
    return not s.isascii() and (len(s) - len(_DEVA.sub("", s))) / total > 0.15


def _display(text: str) -> str:
    lines = [_clean_line(stripped(x)) for x in text.split("\n")]
    return _GAPS.sub("\n\n", "\n".join([x for x in lines if _shown(x)]))


def _column(clean: Callable[[str], str], c: Col) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for t in texts.to_pylist()], pa.string())

    return run(_c(c))


def clean_ocr_tokens(c: Col) -> Column:
    """A text without scan noise: Latin junk, foreign tokens of Devanagari lines, lines of fragments."""
    return _column(_tokens, c)


def clean_display(c: Col) -> Column:
    """clean_ocr_tokens with a gate on lines: by share of script, length, verse numbers or share of odd characters."""
    return _column(_display, c)
