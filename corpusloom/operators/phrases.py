"""Which of many phrases a text contains: a multi-pattern automaton over Arrow batches, in one pass over each text."""
from __future__ import annotations

import math
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that one automaton holds; a table of more is dealt by hash into shards of about so many.
SHARD = 4_000_000


def phrase_matcher(phrases: DataFrame, column: str, shard: int = SHARD) -> Callable[[Column], Column]:
    """A function of a text column that gives the distinct phrases (of the table's column) which the text contains.

    Every phrase counts, whether or not it lies in another; a null or empty one is in nothing, and a null text holds none.
    The size is checked: a shard's phrases go to the tasks, each task builds its automaton once, and each text runs through
    one automaton for each shard.
    """
    spark = phrases.sparkSession
    listed = phrases.select(F.col(column).alias("p")).where(F.col("p") != "").distinct()
    size = listed.agg(F.sum(F.length("p"))).first()[0] or 0
    shards = math.ceil(size / shard)
    udfs = []
    for i in range(shards):
        own = [r["p"] for r in listed.where(F.pmod(F.xxhash64("p"), F.lit(shards)) == i).collect()]  # about `shard` characters
        udfs.append(_matcher(spark.sparkContext.broadcast(own)))

    def matched(text: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(none, *[F.coalesce(match(text), none) for match in udfs])

    return matched


def _matcher(shared):
    held = {}

    @F.pandas_udf("array<string>")
    def match(texts: pd.Series) -> pd.Series:
        if "automaton" not in held:
            held["automaton"] = ahocorasick.Automaton()
            for p in shared.value:
                held["automaton"].add_word(p, p)
            held["automaton"].make_automaton()
        own = held["automaton"] if shared.value else None
        return texts.map(lambda t: sorted({p for _, p in own.iter(t)}) if own is not None and t else [])

    return match


def containing_phrases(df: DataFrame, text: Column, phrases: DataFrame, column: str, shard: int = SHARD) -> DataFrame:
    """`df` with `phrase`: a row for each phrase that the text contains; rows that contain none go."""
    return df.withColumn("phrase", F.explode(phrase_matcher(phrases, column, shard)(text)))
