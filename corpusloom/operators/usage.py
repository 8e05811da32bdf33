"""Usage policy over event tables, conversation turns, and almanac-free calendar picks."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IST = "INTERVAL '05:30' HOUR TO MINUTE"


def quota_decisions(events: DataFrame, limits: Column, *, exempt: Column | None = None, offset: str = IST) -> DataFrame:
    """events (event_id, identity, feature, ts) with day, attempt, allowed and remaining.

    The n-th attempt of an identity at a feature on a local day is allowed while n <= limit; as rejected ones don't
    count, that is a rank. Exempt identities are unlimited (null remaining)."""
    free = F.lit(False) if exempt is None else exempt
    day = F.to_date(F.col("ts") + F.expr(offset))
    w = Window.partitionBy("identity", "feature", "day").orderBy("ts", "event_id")
    out = events.withColumn("day", day).withColumn("attempt", F.row_number().over(w)).withColumn("_l", limits).withColumn("_f", free)
    return out.withColumn("allowed", F.col("_f") | (F.col("attempt") <= F.col("_l"))).withColumn(
        "remaining", F.when(~F.col("_f"), F.greatest(F.lit(0), F.col("_l") - F.col("attempt")))
    ).drop("_l", "_f")


def rate_limit(events: DataFrame, key: str, *, limit: int = 20, ttl: int = 60, mode: str = "kv") -> DataFrame:
    """`(key, event_id, accepted)` of events (event_id, key, ts), by each key's events in order of time and id.

    kv: an accepted hit renews a counter for ttl seconds, a rejected one touches nothing. fixed: a window opens at the
    first hit and a new one at the first hit more than ttl later. One pass over the sorted events holds a key's last time
    and count alone, however many events it has."""
    span = ttl * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, n = object(), None, 0
        for batch in batches:
            accepted = []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != now:
                    now, at, n = own, None, 0
                alive = at is not None and (t - at < span if mode == "kv" else t - at <= span)
                if not alive:
                    n = 0
                    if mode != "kv":
                        at = t
                ok = n < limit
                if ok:
                    n += 1
                    if mode == "kv":
                        at = t
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(accepted, pa.bool_())], [key, "event_id", "accepted"])

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    kinds = dict(events.dtypes)
    schema = f"`{key}` {kinds[key]}, event_id {kinds['event_id']}, accepted boolean"
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInArrow(fold, schema)


def reading_progress(events: DataFrame) -> DataFrame:
    """(user_id, book, chapter): farthest chapter."""
    return events.groupBy("user_id", "book").agg(F.max("chapter").alias("chapter"))


def bookmarks(events: DataFrame) -> DataFrame:
    """(user_id, item): set if it was toggled an odd number of times."""
    return events.groupBy("user_id", "item").agg((F.count("*") % 2 == 1).alias("marked"))


def merge_turns(turns: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Runs of turns of one role become one, joined by a blank line; empty turns and other roles are dropped first."""
    kept = turns.where(F.col("role").isin(*roles) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = kept.withColumn("_new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1)))
    runs = new.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run").agg(
        F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("turns"))


def recent_turns(turns: DataFrame, n: int = 60) -> DataFrame:
    """The last n turns with text of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.where(F.trim("text") != "").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def drop_rapid_repeats(turns: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Without turns equal to the one before within `seconds` (conv_id, ts, turn, text): compares neighbours, so of three
    equal turns 0.7 s apart the third goes too, where a comparison with the last accepted one would keep it."""
    w = Window.partitionBy("conv_id").orderBy("ts", "turn")
    same = (F.lag("text").over(w) == F.col("text")) & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) < int(seconds * 1e6))
    return turns.withColumn("_s", F.coalesce(same, F.lit(False))).where(~F.col("_s")).drop("_s")


def dedupe_ids(turns: DataFrame) -> DataFrame:
    """Blank ids and all but the first of equal ones (by ts) get a new one from conversation, place and text."""
    w = Window.partitionBy("conv_id", "id").orderBy("ts", "text")
    fresh = F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws("|", "conv_id", "id", F.row_number().over(w), "text"), 256), 1, 12))
    return turns.withColumn("id", F.when((F.coalesce("id", F.lit("")) == "") | (F.row_number().over(w) > 1), fresh).otherwise(F.col("id")))


def drop_repeat_lines(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """`df` with `text` less repeated lines: lines over 45 characters (number marks aside) seen before, and those of 30
    or more equal to the last kept. Short lines stay."""
    norm = F.lower(F.trim(F.regexp_replace("t", r"^\s*[\d•*\-]+[.)]?\s*", "")))
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "t")).withColumn("n", norm)
    first = Window.partitionBy(key, "n").orderBy("i")
    lines = lines.withColumn("rn", F.row_number().over(first)).where((F.length("n") <= 45) | (F.col("rn") == 1))
    before = F.last(F.when(F.length("n") >= 30, F.col("n")), ignorenulls=True).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("b", before).where((F.length("n") < 30) | F.col("b").isNull() | (F.col("b") != F.col("n")))
    joined = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("_text"))
    return df.drop(text).join(joined, key, "left").withColumnRenamed("_text", text)


def order_by_list(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """`df` with `place`: position in a fixed list, those not in it last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1))


def reminder_audience(subscribers: DataFrame, hour: int, cap: int = 300) -> DataFrame:
    """For one firing: live subscribers (user_id, expired, name) with their slot and message, the first `cap` by id."""
    slot = "morning" if hour < 11 else "afternoon" if hour < 16 else "evening"
    text = F.concat(F.when(F.coalesce("name", F.lit("")) != "", F.concat("name", F.lit(", "))).otherwise(""), F.lit(f"your {slot} reading is ready"))
    return subscribers.where("not expired").select("user_id", F.lit(slot).alias("slot"), text.alias("message")).orderBy("user_id").limit(cap)


def readable(df: DataFrame, rights: DataFrame) -> DataFrame:
    """`df` (book) with `open` and `publisher`: open only where rights (book, access, publisher) say so."""
    return df.join(rights, "book", "left").withColumn("open", F.coalesce(F.col("access") == "open", F.lit(False))).drop("access")


def guard_files(files: DataFrame, least: int = 100, most: int = 50 << 20) -> DataFrame:
    """Per upload (upload, name, bytes): whether all sizes are allowed and several files are all images."""
    image = F.lower("name").rlike(r"\.(png|jpe?g|webp|gif|bmp|heic)$")
    return files.groupBy("upload").agg((F.bool_and(F.col("bytes").between(least, most)) & ((F.count("*") == 1) | F.bool_and(image))).alias("accepted"))
