"""Places in an order that holds for the whole table, without gathering a group anywhere.

The rows are dealt into ranges of the order, sorted within each and written once with their range and their place in it.
What a range needs of those before it is one carried number: how many rows they hold. So a group of half of all rows
runs in as many tasks as it takes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: A range's rows are numbered in the low bits of what monotonically_increasing_id gives.
PLACES = 33


def ordered(df: DataFrame, *order: Column | str, scratch: Scratch, row: str = "row") -> DataFrame:
    """`df`, written to `scratch`, with `row`: each row's place from 0 in the order, over the whole table.

    Rows that tie in `order` get different places, in no order among them. Null sorts as Spark has it (first if
    ascending). The table of carried offsets has a row for each range, so it is broadcast.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    laid = scratch.staged(laid)
    part = F.shiftright("_id", PLACES)
    held = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = held.select("_part", before.alias("_before"))
    placed = laid.withColumn("_part", part).join(F.broadcast(carried), "_part")
    at = F.col("_id").bitwiseAND((1 << PLACES) - 1)
    return placed.withColumn(row, F.col("_before") + at).drop("_part", "_id", "_before")


def places(df: DataFrame, group: str, *order: Column | str, scratch: Scratch, place: str = "i") -> DataFrame:
    """`df` with `i` (or the name given), each row's place from 0 in its group by `order`, `c`, the group's rows, and `row`, the place in all.

    A group's first place and size are one row, combined before the shuffle; a hot group is the side that Spark can split.
    Null is a group of its own.
    """
    laid = ordered(df, group, *order, scratch=scratch)
    of = laid.groupBy(F.col(group).alias("_g")).agg(F.min("row").alias("_first"), F.count("*").alias("c"))
    placed = laid.join(of, F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn(place, F.col("row") - F.col("_first")).drop("_g", "_first")
