"""Quality rules (8), native: fixed rules on word statistics, then robust multivariate outliers.

Per language and source the minimum covariance determinant of the transformed statistics: of all subsets of KEEP of the
documents, the one whose covariance has the least determinant gives centre and scatter. It is approached from four starts
(see `_starts`) by concentration steps: take the KEEP of the documents that lie nearest by the estimate so far, and their
mean and covariance as the next. Of all starts and steps the estimate of least determinant is used. Documents beyond a
chi-squared bound on the Mahalanobis distance are rejected. Each step is one aggregation over (group, start, distance
bin), so a group of any size is pre-aggregated before the shuffle; only the few bins of a group come together. The bin
at the border counts in part, so that all subsets of a group weigh the same.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut
from .keys import texts

#: Transformed statistics: word length, symbols, repeated words, words, repeated lines.
FEATURES = ("f0", "f1", "f2", "f3", "f4")
KEEP = 0.75  # share of a group that an estimate rests on
FLOOR = 0.01  # least standard deviation of a statistic, against singular matrices only
#: Statistics that are 0 in most documents have no scatter to estimate: they are taken to vary this much at least.
COUNTED, COUNTED_FLOOR = ("f1", "f2", "f4"), 0.3
BINS = 64  # distance bins to a factor of e


def _chi2(x: float, d: int) -> float:
    """P(chi-squared with d degrees of freedom <= x)."""
    beyond, i = (math.erfc(math.sqrt(x / 2)), 1) if d % 2 else (math.exp(-x / 2), 2)
    while i < d:
        beyond += (x / 2) ** (i / 2) * math.exp(-x / 2) / math.gamma(i / 2 + 1)
        i += 2
    return 1 - beyond


def _quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, d) < p else (low, mid)
    return low


def _consistency(d: int) -> float:
    """What makes the scatter of the nearest KEEP of normal data of d statistics consistent."""
    return KEEP / _chi2(_quantile(KEEP, d), d + 2)


def _used(columns: list[str]) -> list[str]:
    """The statistics that rows (f0, ...) or estimates (m0, ...) have."""
    return [f for f in FEATURES if f in columns or f.replace("f", "m") in columns]


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def word_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`k, doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words` of whole texts."""
    rows = texts(docs, doc_id, text, F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"))
    rows = rows.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # hashes of the three-word windows with their places; sorted, equal windows lie side by side
    rows = rows.select(
        "k", "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 4, F.expr("sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) as h, i as i)))")).alias("t"),
    )
    again = F.expr(
        "sort_array(transform(filter(transform(t, (x, i) -> if(get(t, i - 1).h = x.h or get(t, i + 1).h = x.h, x.i, null)), x -> x is not null), x -> x))"
    )
    rows = rows.withColumn("again", F.coalesce(again, F.array().cast("array<int>"))).drop("t")
    covered = F.expr("aggregate(again, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last)).n")
    return rows.withColumn("n_repeat_words", covered).drop("again")


def transformed(stats: DataFrame) -> DataFrame:
    n, c = F.col("n_words"), F.col("word_chars")
    return stats.select(
        "*",
        F.log(F.greatest(c, F.lit(1)) / F.greatest(n, F.lit(1))).alias("f0"),
        F.log1p(100 * F.col("n_symbols") / F.greatest(c, F.lit(1))).alias("f1"),
        F.log1p(10 * F.col("n_repeat_words") / F.greatest(n, F.lit(1))).alias("f2"),
        F.log1p(n.cast("double")).alias("f3"),
        F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("f4"),
    )


def _distance(used: tuple[str, ...] | list[str] = FEATURES, estimate: str = "e") -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor of the joined estimate."""
    y: list[Column] = []
    for i in range(len(used)):
        rest = F.col(used[i]) - F.col(f"{estimate}.m{i}")
        for j in range(i):
            rest = rest - F.col(f"{estimate}.l{i}{j}") * y[j]
        y.append(rest / F.col(f"{estimate}.l{i}{i}"))
    return sum((x * x for x in y[1:]), y[0] * y[0])


def _factored(estimates: DataFrame) -> DataFrame:
    """`g, s, e, size`: mean m and Cholesky factor l of the covariance c, whose diagonal is at least the floor, and the logarithm of its determinant."""
    known, used = estimates, _used(estimates.columns)
    for i, j in _pairs(len(used)):
        value = F.col(f"c{i}{j}")
        if i == j:
            value = F.greatest(value, F.lit(COUNTED_FLOOR**2 if used[i] in COUNTED else FLOOR**2))
        for p in range(j):
            value = value - F.col(f"l{i}{p}") * F.col(f"l{j}{p}")
        known = known.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOOR**2))) if i == j else value / F.col(f"l{j}{j}"))
    size = sum((F.log(f"l{i}{i}") for i in range(1, len(used))), F.log("l00"))
    return known.select("g", "s", F.struct(*[f"m{i}" for i in range(len(used))], *[f"l{i}{j}" for i, j in _pairs(len(used))]).alias("e"), (2 * size).alias("size"))


def _moments(used: list[str]) -> list[Column]:
    """Weighted sums of the statistics (a0, ...) and of their products (q00, ...), and of the weights (n)."""
    return [
        F.sum("weight").alias("n"), *[F.sum(F.col("weight") * F.col(f)).alias(f"a{i}") for i, f in enumerate(used)],
        *[F.sum(F.col("weight") * F.col(used[i]) * F.col(used[j])).alias(f"q{i}{j}") for i, j in _pairs(len(used))],
    ]


def _estimate(sums: DataFrame, d: int, scale: float = 1.0) -> DataFrame:
    """Means and covariances, times scale, from `_moments`."""
    mean = [F.col(f"a{i}") / F.col("n") for i in range(d)]
    return sums.select(
        "g", "s", *[mean[i].alias(f"m{i}") for i in range(d)],
        *[(scale * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j])).alias(f"c{i}{j}") for i, j in _pairs(d)],
    )


#: What the starts are: quartiles alone, covariance of all, of hyperbolic tangents of standardised statistics, of their directions.
STARTS = ("quartiles", "plain", "tangents", "directions")


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of each group, a row for each of STARTS."""
    used = _used(rows.columns)
    d = len(used)
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, f in enumerate(used)])
    quartiles = quartiles.select(
        "g", *[F.col(f"p{i}")[1].alias(f"mid{i}") for i in range(d)],
        *[F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(COUNTED_FLOOR if f in COUNTED else FLOOR)).alias(f"wide{i}") for i, f in enumerate(used)],
    )
    z = rows.join(quartiles, "g").select("g", *used, *[((F.col(f) - F.col(f"mid{i}")) / F.col(f"wide{i}")).alias(f"z{i}") for i, f in enumerate(used)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0")))
    seen = z.withColumn("norm", F.greatest(norm, F.lit(1e-9))).select("g", F.explode(F.array(
        F.struct(F.lit(1).alias("s"), *[F.col(f).alias(f) for f in used]),
        F.struct(F.lit(2).alias("s"), *[F.tanh(f"z{i}").alias(f) for i, f in enumerate(used)]),
        F.struct(F.lit(3).alias("s"), *[(F.col(f"z{i}") / F.col("norm")).alias(f) for i, f in enumerate(used)]),
    )).alias("x")).select("g", "x.*", F.lit(1.0).alias("weight"))
    shape = _estimate(seen.groupBy("g", "s").agg(*_moments(used)), d)
    # the last two give correlations alone: places and widths are the quartiles'
    shape = shape.join(quartiles, "g")
    width = lambda i: F.sqrt(F.greatest(F.col(f"c{i}{i}"), F.lit(1e-12)))
    shaped = shape.select(
        "g", "s", *[F.when(F.col("s") == 1, F.col(f"m{i}")).otherwise(F.col(f"mid{i}")).alias(f"m{i}") for i in range(d)],
        *[F.when(F.col("s") == 1, F.col(f"c{i}{j}")).otherwise(
            F.col(f"c{i}{j}") / (width(i) * width(j)) * F.col(f"wide{i}") * F.col(f"wide{j}")).alias(f"c{i}{j}") for i, j in _pairs(d)],
    )
    alone = quartiles.select(
        "g", F.lit(0).alias("s"), *[F.col(f"mid{i}").alias(f"m{i}") for i in range(d)],
        *[(F.col(f"wide{i}") * F.col(f"wide{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs(d)],
    )
    return alone.unionByName(shaped)


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest KEEP of each group, from each estimate."""
    used = _used(rows.columns)
    d = len(used)
    near = rows.join(_factored(estimates), "g").withColumn("d", _distance(used)).withColumn("weight", F.lit(1.0))
    bins = near.groupBy("g", "s", F.floor(F.log(F.col("d") + 1e-9) * BINS).alias("bin")).agg(*_moments(used))
    # bins from the nearest until they hold KEEP of the rows; the last counts in part
    ranked = bins.selectExpr("*", "sum(n) over (partition by g, s order by bin) - n as before", "sum(n) over (partition by g, s) as whole")
    share = F.least(F.lit(1.0), (KEEP * F.col("whole") - F.col("before")) / F.col("n"))
    sums = [c for c in bins.columns if c not in ("g", "s", "bin")]
    kept = ranked.withColumn("share", share).where("share > 0").groupBy("g", "s").agg(*[F.sum(F.col("share") * F.col(c)).alias(c) for c in sums])
    return _estimate(kept, d, _consistency(d))


def least_determinant(scratch: Scratch, rows: DataFrame, steps: int) -> DataFrame:
    """`g, e`: of the estimates after each step from each start, the one of least determinant; of equal ones the first start's and step's."""
    estimates, found = scratch.staged(_starts(rows)), []
    for i in range(steps):
        estimates = scratch.staged(_step(rows, estimates))
        found.append(_factored(estimates).withColumn("step", F.lit(i)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("g").agg(F.min_by("e", F.struct(F.round("size", 6), "s", "step")).alias("e"))


def quality_verdicts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    least_words: int = 50, most_repeat: int = 50, steps: int = 4, least_group: int = 30, tail: float = 1e-3,
) -> DataFrame:
    """`k, doc_id`, the word statistics, `base_failed, distance, kept` for every row.

    base_failed: fewer than least_words words, or 100 * n_repeat_words > most_repeat * n_words. The other documents are
    estimated per (lang, source), null being a value of its own; a group under least_group is judged by the estimate of
    its whole language, and if that is smaller too, of the whole table (in a table under least_group there is none: null
    distance, all kept). A document is rejected if its squared distance is beyond the chi-squared quantile of 1 - tail.
    Null and blank texts fail the base rules. Very long texts are read whole. Documents of equal distance share their
    verdict; repeated rows are judged each and weigh in as many times. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.staged(transformed(word_statistics(docs, doc_id=doc_id, text=text, lang=lang, source=source)).withColumn(
            "base_failed", F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeat} * n_words")
        ))
        return cut(_judged(scratch, stats, steps, least_group, tail))


def _judged(scratch: Scratch, stats: DataFrame, steps: int, least_group: int, tail: float) -> DataFrame:
    counts = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    counts = scratch.staged(counts.join(counts.groupBy("lang").agg(F.sum("n").alias("of_lang")), "lang"))
    of_all = counts.agg(F.sum("n")).first()[0] or 0
    # the estimate that judges each group: its own, its language's or the table's
    level = F.when(F.col("n") >= least_group, 0).when(F.col("of_lang") >= least_group, 1).when(F.lit(of_all >= least_group), 2)
    name = [F.xxhash64(F.lit(0), "lang", "source"), F.xxhash64(F.lit(1), "lang"), F.xxhash64(F.lit(2))]
    g = F.when(level == 0, name[0]).when(level == 1, name[1]).when(level == 2, name[2])
    named = scratch.staged(counts.select("lang", "source", g.alias("g")).where("g is not null"))
    # every group is part of its own estimate, its language's and the table's, so far as these judge any
    parts = counts.select("lang", "source", F.explode(F.array(*name)).alias("g")).join(named.select("g").distinct(), "g", "left_semi")
    rows = stats.where("not base_failed").join(parts, ["lang", "source"]).select("g", *FEATURES)
    judged = stats.join(named, ["lang", "source"], "left").join(least_determinant(scratch, rows, steps), "g", "left")
    bound = _quantile(1 - tail, len(FEATURES))
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.select(
        "k", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= bound)).alias("kept"),
    )
