"""Language ID (3): Bayesian fusion of text likelihood, declared language, address suffix and host prior.

Text: a naive Bayes model over hashed byte trigrams, whose counts come from all rows by declared language. Beside the
languages there is one class for text of no known language, under which all trigrams are alike. Declared language and
address suffix: the probability of what is declared, given the language, counted against the text's own verdicts. Host:
a prior over languages, smoothed towards that of its registered domain, and that towards the whole table's. All counts
are grouped aggregations; a row's own verdict is taken out of its host's counts before they judge it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut
from .keys import doc_key, rows_back, whole_rows

BUCKETS = 1 << 15  # trigram hash values, a fixed table
CLASSES = 64  # languages of a block: its table has 8 MB
NONE = "und"  # no known language


def _trigrams(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte of the batch, which of them count, and the texts' bounds."""
    data = batch.cast(pa.large_binary())
    bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    low = np.where((low < 65), np.uint8(32), low).astype(np.uint32)  # digits, marks and blanks are a gap
    if len(low) < 3:
        return np.zeros(len(low), np.uint32), np.zeros(len(low), bool), bounds
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    bucket = np.zeros(len(low), np.uint32)
    bucket[:-2] = (code * np.uint32(2654435761)) >> np.uint32(17)
    counts = np.zeros(len(low), bool)
    counts[:-2] = (low[:-2] != 32) | (low[1:-1] != 32)
    for end in (1, 2):  # no trigram over the end of a text
        at = bounds[1:] - end
        counts[at[at >= 0]] = False
    return bucket, counts, bounds


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def declared_languages(rows: DataFrame) -> list[str]:
    """All declared languages, most declared first: 26 * 26 + 26 ** 3 at most, as `_subtag` lets no others through."""
    counts = rows.where("declared <> ''").groupBy("declared").agg(F.count("*").alias("n"))
    return [r["declared"] for r in counts.orderBy(F.desc("n"), "declared").collect()]


def trigram_counts(rows: DataFrame) -> DataFrame:
    """`declared, bucket, n`: how often the texts of each declared language have each trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["declared", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                bucket, counts, bounds = _trigrams(part.column(0))
                names = part.column(1).to_pylist()
                place = {name: j for j, name in enumerate(sorted(set(names)))}
                lang = np.repeat(np.array([place[x] for x in names], np.int64), np.diff(bounds))
                for name, j in place.items():
                    if name not in sums and len(sums) == CLASSES:
                        yield from flush()
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(bucket[counts & (lang == j)], minlength=BUCKETS)
        yield from flush()

    got = rows.where("declared <> ''").select("text", "declared").mapInArrow(count, "declared string, bucket int, n long")
    return got.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def trigram_table(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Log probability of each bucket (rows) in each language of a block (columns); NONE has all alike."""
    table = np.full((BUCKETS, len(names)), 0.5)
    got = counts.where(F.col("declared").isin(names)).toPandas()  # BUCKETS rows a language of the block at most
    place = {name: j for j, name in enumerate(names)}
    table[got["bucket"], [place[x] for x in got["declared"]]] += got["n"]
    table = np.log(table / table.sum(axis=0))
    if NONE in place:
        table[:, place[NONE]] = -np.log(BUCKETS)
    return table.astype(np.float32)


def _log_likelihoods(rows: DataFrame, shared: Broadcast, per_text: int) -> DataFrame:
    """rows with the block's log likelihoods appended to `ll`. Trigrams aren't independent: they weigh per_text at most."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                bucket, counts, bounds = _trigrams(part["text"])
                n = _per_text(counts.astype(np.float64), bounds)
                ll = np.column_stack([_per_text(by_bucket[:, j][bucket] * counts, bounds) for j in range(by_bucket.shape[1])])
                ll *= np.minimum(1.0, per_text / np.maximum(n, 1))[:, None]
                before = part["ll"].to_pylist()
                fresh = {"ll": pa.array([np.append(x, y) for x, y in zip(before, ll, strict=True)], pa.list_(pa.float64())), "n_trigrams": pa.array(n.astype(np.int64))}
                yield pa.RecordBatch.from_arrays([fresh.get(c, part[c]) for c in part.schema.names], part.schema.names)

    return rows.mapInArrow(score, rows.schema)


def text_likelihoods(scratch: Scratch, rows: DataFrame, names: list[str], per_text: int) -> DataFrame:
    """rows with `text` replaced by `ll`, a log likelihood for each of `names` (and NONE, the last of them), and `n_trigrams`.

    Languages are scored in blocks of CLASSES: a pass over the texts for each block, whose table alone is sent to tasks.
    """
    counts = scratch.staged(trigram_counts(rows))
    scored = rows.withColumn("ll", F.array().cast("array<double>")).withColumn("n_trigrams", F.lit(0).cast("long"))
    before = None
    for i in range(0, len(names), CLASSES):
        shared = rows.sparkSession.sparkContext.broadcast(trigram_table(counts, names[i : i + CLASSES]))
        passed = _log_likelihoods(scored, shared, per_text)
        scored = scratch.staged(passed.drop("text") if i + CLASSES >= len(names) else passed)
        shared.destroy()
        if before is not None:
            scratch.drop(before)
        before = scored
    scratch.drop(counts)
    return scored


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two labels) and suffix (last label) of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def _subtag(declared: Column) -> Column:
    """The language alone of a declaration such as `en-GB`, in lower case: two or three letters, as language codes have; else empty."""
    return F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    """What a web page declares: the language of its markup, and host, registered domain and suffix of its address."""
    host, domain, suffix = address_parts(url)
    declared = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]+)""", 1)
    return {"declared": declared, "host": host, "domain": domain, "suffix": suffix}


def page_text(html: Column) -> Column:
    """The text of a page: what lies outside of tags, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")


def identify_language(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", declared: Column | None = None, host: Column | None = None,
    domain: Column | None = None, suffix: Column | None = None, per_text: int = 200, prior: float = 20.0,
    least: float = 0.5,
) -> DataFrame:
    """`k, doc_id, text_hash, language, probability, text_language, kept` for every row.

    declared, host, domain and suffix are string columns (of a declared `en-GB`, `en` counts; what begins with no code of two or
    three letters declares nothing), null or empty where there is no such evidence. kept is false
    for a text without a trigram of letters (null and empty ones too), and where the most probable class is NONE or less
    probable than `least`. `prior` is the weight, in rows, with which each level of hosts is drawn to the one above.
    Repeated rows are judged each; of classes that tie, the first in the list of languages wins. Very long texts are read
    whole. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    empty = F.lit("")
    evidence = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    rows = docs.select(
        doc_key(doc_id, text).alias("k"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), empty).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), empty)).alias("text_hash"),
        *[F.coalesce(_subtag(c) if n == "declared" else c, empty).alias(n) if c is not None else empty.alias(n) for n, c in evidence.items()],
    )
    with Scratch(docs.sparkSession) as scratch:
        return cut(_fused(scratch, rows, per_text, prior, least))


def _fused(scratch: Scratch, rows: DataFrame, per_text: int, prior: float, least: float) -> DataFrame:
    names = [x for x in declared_languages(rows) if x != NONE] + [NONE]
    m = len(names)
    scored = text_likelihoods(scratch, rows, names, per_text).withColumn("best", F.expr("int(array_position(ll, array_max(ll)) - 1)"))
    sure = scored.where("n_trigrams > 0")

    def counted(*by: str) -> DataFrame:
        """Verdicts of the text alone, per group: an array of m counts, combined before the shuffle."""
        per = sure.groupBy(*by, "best").agg(F.count("*").alias("n"))
        met = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("c"))
        return met.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0).cast("bigint"))))

    def constants(values: list, kind: str) -> Column:
        """One literal of many values, which holds no comma."""
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    zero = F.array_repeat(F.lit(0).cast("bigint"), m)
    verdicts = {r["best"]: r["n"] for r in sure.groupBy("best").agg(F.count("*").alias("n")).collect()}  # one row a class
    whole = [verdicts.get(i, 0) for i in range(m)]
    total = sum(whole)
    top = constants([(x + 1.0) / (total + m) for x in whole], "double")
    mixed = lambda c, up: F.expr(
        f"zip_with({c}, {up}, (n, p) -> (n + {prior} * p) / (aggregate({c}, 0L, (s, x) -> s + x) + {prior}))"
    )
    # a row's own verdict doesn't count for its host
    less = lambda c: F.expr(f"transform({c}, (x, i) -> if(i = best and n_trigrams > 0 and x > 0, x - 1, x))")
    out = scored
    for level in ("domain", "host"):
        per = counted(level).withColumnRenamed("c", f"{level}_c")
        out = out.join(per, level, "left").withColumn(f"{level}_c", less(f"coalesce({level}_c, array_repeat(0L, {m}))"))
    out = out.withColumn("p0", top)
    out = out.withColumn("p1", F.when(F.col("domain") == "", F.col("p0")).otherwise(mixed("domain_c", "p0")))
    out = out.withColumn("p2", F.when(F.col("host") == "", F.col("p1")).otherwise(mixed("host_c", "p1")))
    # probability of the declaration given the language; without one it says nothing
    for kind in ("declared", "suffix"):
        per = counted(kind).withColumnRenamed("c", f"{kind}_c")
        out = out.join(per, kind, "left").withColumn(
            f"{kind}_l",
            F.when(F.col(kind) == "", F.array_repeat(F.lit(0.0), m)).otherwise(
                F.transform(F.coalesce(f"{kind}_c", zero), lambda x, i: F.log((x + 0.5) / (F.get(constants(whole, "double"), i) + 1.0 * m)))
            ),
        )
    logs = F.expr("transform(ll, (x, i) -> x + ln(p2[i]) + declared_l[i] + suffix_l[i])")
    out = out.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    out = out.withColumn("at", F.expr("int(array_position(logs, most) - 1)")).withColumn(
        "probability", 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    )
    listed = constants(names, "string")
    language = F.get(listed, F.col("at"))
    return out.select(
        "k", "doc_id", "text_hash", language.alias("language"), F.round("probability", 6).alias("probability"),
        F.when(F.col("n_trigrams") > 0, F.get(listed, F.col("best"))).alias("text_language"),
        ((F.col("n_trigrams") > 0) & (language != NONE) & (F.col("probability") >= least)).alias("kept"),
    )

def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, whose language is identified. Rows of equal id and text are kept or not as one."""
    bad = identify_language(docs, doc_id=doc_id, text=text, **options).where("not kept").select("k", "text_hash").distinct()
    keyed = whole_rows(docs, k=doc_key(doc_id, text), text_hash=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return rows_back(keyed.join(bad, ["k", "text_hash"], "left_anti"))
