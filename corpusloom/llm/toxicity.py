"""Toxicity (5): compression-distance classification with two zstandard dictionaries.

Texts are cut into windows of one word (or a few). The ordinary dictionary is trained on the words of ordinary documents.
The toxic one is trained on those words of toxic documents that are several times as common among them as among the
ordinary ones: toxic documents are ordinary text for the most part, which would fill the dictionary. The bytes that the
toxic dictionary saves over the ordinary one are a window's score. The threshold on windows, the weights and cut of the
document's score, and which of a few trainings is taken, are calibrated on whole texts of other labelled rows.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import texts

_WORD = re.compile(r"\w+")
#: Behind every window and at the end of both dictionaries: zstandard finds no match in the last bytes of its input.
FRAME = b"#0123456789@abcdefghij#KLMNOPQRSTUVWXYZ#"
CUT = 0.7  # the score from which a document is predicted toxic
WINDOW = 3  # words
THRESHOLDS = range(3, 12)  # bytes
LEAST = 0.02  # weight of a feature that tells nothing
ORDINARY = 32768  # bytes of the ordinary dictionary
#: Trainings of the toxic dictionary to choose from: in how many documents a word must be at least, how many times as common it
#: must be among toxic ones, bytes of the dictionary, and the trainer's segment and match lengths.
TRAININGS = ((2, 4, 4096, 16, 6), (2, 8, 32768, 32, 6), (3, 6, 32768, 64, 8))


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    words = _WORD.findall(text.lower())
    return [" ".join(words[i : i + size]).encode() for i in range(0, len(words), size)]


def compressor(content: bytes):
    """Length of a window compressed with a dictionary of this content."""
    plain = zs.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=15, search_log=6, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=plain)
    compress = zs.ZstdCompressor(dict_data=d, compression_params=plain).compress
    return lambda window: len(compress(b" " + window + b" " + FRAME))


class Dictionaries(dict):
    """The two dictionaries; as a mapping, the bytes that the toxic one saves in a window (computed once while it is held)."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.ordinary, self.toxic = ordinary, toxic
        self.lengths = compressor(ordinary), compressor(toxic)

    def __missing__(self, window: bytes) -> int:
        a, b = self.lengths
        if len(self) > 300_000:
            self.clear()
        saved = self[window] = a(window) - b(window)
        return saved

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.float64, len(found))


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zs.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zs.ZstdError:  # too little text to train on: its own content is the dictionary
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[dict[str, int]], ordinary: list[dict[str, int]], window: int = WINDOW) -> list[Dictionaries]:
    """One pair for each of TRAININGS, from the words of toxic and of ordinary documents and how often each has them.

    In windows of several words the ordinary dictionary stands in front of the toxic one, so that the ordinary words
    beside a toxic one cost the same with both."""
    of = [Counter(w for words in rows for w in words) for rows in (toxic, ordinary)]
    sample = lambda words, of=None: "".join(f" {w}" * n for w, n in words.items() if of is None or w in of).encode() + b" "
    base, found = _trained([sample(x) for x in ordinary], ORDINARY, 64, 6), []
    for least, ratio, size, k, d in TRAININGS:
        chosen = {w for w, n in of[0].items() if n >= least and n * (len(ordinary) + 1) >= ratio * (of[1][w] + 1) * len(toxic)}
        own = [sample(words, chosen) for words in toxic if not chosen.isdisjoint(words)]
        found.append(Dictionaries(base + FRAME, (base if window > 1 else b"") + _trained(own, size, k, d) + FRAME))
    return found


def _features(hits: float, most: float, n: int) -> list[float]:
    return [1.0, math.log1p(hits), most, 100.0 * hits / (100 + n)]


class Model:
    """Dictionaries, the window threshold, the weights of the document score, and the words of a window."""

    def __init__(self, dictionaries: Dictionaries, threshold: float, weights: list[float], window: int):
        self.dictionaries, self.threshold, self.weights, self.window = dictionaries, threshold, weights, window

    def score(self, text: str) -> float:
        saved = self.dictionaries.of(windows(text, self.window))
        x = _features(float((saved >= self.threshold).sum()), float(saved.max(initial=0.0)), len(saved))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.weights, x, strict=True))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of which only the first may be under LEAST: more hits never lower a score, and texts without any are in
    order of their best window."""
    on = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[on] = _logistic(x[:, on], y)
        low = w < 0
        low[0] = False
        if not low.any():
            return np.append(w[:1], np.maximum(w[1:], LEAST))
        on &= ~low


def _best_cut(s: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[float, float | None]:
    """The best F score of any cut, precision weighing more than recall (beta 0.5), and the cut: half way to the next lower value."""
    order = np.argsort(-s, kind="stable")
    s, y = s[order], y[order]
    hit = np.cumsum(y)
    f1 = np.where(np.append(s[:-1] > s[1:], True), 1.25 * hit / (np.cumsum(np.where(y > 0, 1.0, weight)) + 0.25 * max(1.0, y.sum())), -1)
    if not len(y):
        return 0.0, None
    i = int(np.argmax(f1))
    return float(f1[i]), float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1)


def _auc(s: np.ndarray, y: np.ndarray) -> float:
    """How often a toxic row scores above an ordinary one."""
    low, high = np.sort(s[y == 0]), s[y == 1]
    if not len(low) or not len(high):
        return 0.5
    return float((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")).mean() / 2 / len(low))


def _calibrated(found: list[Dictionaries], counts: list[tuple], weight: float, window: int) -> Model:
    """The training, threshold, weights and cut with the best separation of the rows (y, training, n, most, hits by threshold)."""
    best = None
    for i, dictionaries in enumerate(found):
        own = [c for c in counts if c[1] == i]
        y = np.array([c[0] for c in own], float)
        for j, threshold in enumerate(THRESHOLDS):
            x = np.array([_features(c[4][j], c[3], c[2]) for c in own]).reshape(-1, 4)
            w = _rising(x, y)
            f, cut = _best_cut(x @ w, y, weight)
            if best is None or f + _auc(x @ w, y) > best[0]:
                best = f + _auc(x @ w, y), dictionaries, float(threshold), w, cut
    _, dictionaries, threshold, w, cut = best
    # the best cut of the calibration rows comes to lie at CUT
    w = w.copy()
    w[0] += math.log(CUT / (1 - CUT)) - (cut or 0.0)
    return Model(dictionaries, threshold, w.tolist(), window)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                 per_class: int = 1500, window: int = WINDOW) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1.

    Three quarters of these train the dictionaries, the others calibrate; of either, per_class rows of each label at most
    are taken, by hash of doc_id. The driver gets the distinct words of the rows that train, from whole texts, and of those that
    calibrate how many windows, of whole texts too, reach each threshold. Labels other than 0 and 1 and null ids are left
    out; a null text has no windows; an id with both labels is toxic. An empty table gives a model that scores all alike.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.col(doc_id).cast("long").cast("string"))
    fold = F.when(crc % 3 == 1, 1).when(F.floor(crc / 3) % 4 == 0, 2).otherwise(0)
    given = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"), fold.alias("fold"))
    given = given.where("fold <> 1 and y in (0, 1)").groupBy("doc_id", "fold").agg(F.max("y").alias("y"))
    sample = None
    for f in (0, 2):
        for y in (0, 1):
            part = given.where(f"y = {y} and fold = {f}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
            sample = part if sample is None else sample.unionByName(part)
    # at most 4 * per_class rows
    rows = texts(docs, doc_id, text).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "fold", "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = Counter(_WORD.findall(batch.column(2)[i].as_py().lower()))
                own = [pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(2)), *own], ["doc_id", "y", "words", "times"])

    found = rows.where("fold = 0").select("doc_id", "y", "text").mapInArrow(distinct, "doc_id long, y int, words array<string>, times array<long>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    kept = [(y, dict(zip(words, times, strict=True))) for y, words, times in zip(*(found.column(c).to_pylist() for c in ("y", "words", "times")), strict=True)]
    trained = train_dictionaries(*([x for a, x in kept if a == y] for y in (1, 0)), window)
    shared = spark.sparkContext.broadcast([(d.ordinary, d.toxic) for d in trained])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Dictionaries(*x) for x in shared.value]
        for batch in batches:
            out = []
            for i, y, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = windows(t, window)
                for j, d in enumerate(own):
                    saved = d.of(found)
                    out.append((i, y, j, len(found), float(saved.max(initial=0.0)), [int((saved >= x).sum()) for x in THRESHOLDS]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], "doc_id y training n most hits".split())

    counts = rows.where("fold = 2").select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, training int, n long, most double, hits array<long>")
    counts = sorted(tuple(r) for r in counts.collect())
    shares = {r["y"]: r["n"] for r in given.where("fold = 2").groupBy("y").agg(F.count("*").alias("n")).collect()}
    sampled = {y: min(shares.get(y, 0), per_class) or 1 for y in (0, 1)}
    weight = (shares.get(0, 0) / sampled[0]) / (shares.get(1, 0) / sampled[1] or 1.0) or 1.0
    return _calibrated(trained, [c[1:] for c in counts], weight, window)


def score_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`k, doc_id, held_out, score, predicted` for every row, from its whole text alone.

    Null and empty texts have no window and get the score of that; very long ones are scored whole. held_out: crc32(doc_id
    as text) mod 3 is 1 (false for a null id). Equal texts tie; repeated rows are scored each. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    d = model.dictionaries
    shared = docs.sparkSession.sparkContext.broadcast((d.ordinary, d.toxic, model.threshold, model.weights, model.window))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic, *rest = shared.value
        own = Model(Dictionaries(ordinary, toxic), *rest)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            scores = [own.score(x.as_py()) for x in batch.column(2)]
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())],
                ["k", "doc_id", "held_out", "score", "predicted"],
            )

    return texts(docs, doc_id, text).mapInArrow(rows, "k long, doc_id long, held_out boolean, score double, predicted int")
