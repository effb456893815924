"""Streaming twins of the event-time operators. Lateness is bounded by a watermark, which batch forms have no use for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelane.storage import open_store

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, ts as an instant."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Count and sum by window and key; a window is final when the watermark passes it."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", lateness).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return out


def near_events(left: DataFrame, right: DataFrame, seconds: float, key: str = "user_id", lateness: tuple[str, str] = ("10 minutes", "10 minutes")) -> DataFrame:
    """(key, event_id, ts, near_id, near_ts): pairs of a key's events less than ``seconds`` apart, one of each stream.

    Each stream has its own watermark; a row that is later than its stream's lateness is dropped, and state is kept for ``seconds`` beyond the other's watermark.
    """
    a = left.withWatermark("ts", lateness[0]).select(key, "event_id", "ts")
    b = right.withWatermark("ts", lateness[1]).select(F.col(key).alias("_key"), F.col("event_id").alias("near_id"), F.col("ts").alias("near_ts"))
    apart = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col(key) == F.col("_key")) & (F.col("near_ts") > F.col("ts") - apart) & (F.col("near_ts") < F.col("ts") + apart)
    return a.join(b, near).drop("_key")


def insert_if_absent(events: DataFrame, key: list[str], lateness: str = "10 minutes") -> DataFrame:
    """The first row of each ``key`` to come, while the watermark hasn't passed it by ``lateness``; repeats of a key go, and rows later than ``lateness`` too."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(key)


def running_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Totals by key in update mode; pair with :func:`upsert_sink`."""
    return events.groupBy(key).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def _versions(path: str, kind: str) -> list[int]:
    """Numbers of the folders that are written whole."""
    from pyarrow import fs

    store, root = open_store(path)
    found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith(f"{kind}=")]
    done = store.get_file_info([f"{x.path}/_SUCCESS" for x in found])
    return sorted(int(x.base_name.partition("=")[2]) for x, mark in zip(found, done, strict=True) if mark.type == fs.FileType.File)


def _drop_before(path: str, base: int) -> None:
    """Deletes what readers that start from ``base`` or a later one don't need."""
    store, root = open_store(path)
    for kind in ("version", "base"):
        for n in _versions(path, kind):
            if n < base or kind == "version" and n == base:
                store.delete_dir(f"{root}/{kind}={n}")


def read_upserts(spark: SparkSession, path: str, key: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The newest row of each key of what :func:`upsert_sink` wrote, of all micro-batches or of those up to one."""
    bases = [x for x in _versions(path, "base") if upto is None or x <= upto]
    since = bases[-1] if bases else -1
    folders = [(x, f"{path}/version={x}") for x in _versions(path, "version") if x > since and (upto is None or x <= upto)] + [(since, f"{path}/base={since}") for _ in bases[-1:]]
    rows = spark.createDataFrame([], schema).withColumn("_version", F.lit(0))
    for version, folder in folders:
        rows = rows.unionByName(spark.read.schema(schema).parquet(folder).withColumn("_version", F.lit(version)))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*schema.names), "_version").alias("_row"))
    return newest.select("_row.*")


def upsert_sink(path: str, key: str, compact: int = 32):
    """A foreachBatch function that keeps the newest row of each key: a micro-batch writes its own rows only, and every ``compact`` of them are merged
    into a base that the reader starts from. See :func:`read_upserts`. A batch that is repeated writes the same files again. What lies before the base before the last is deleted: a reader
    that began with the one before can end.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        if (epoch + 1) % compact == 0:
            merged = read_upserts(batch.sparkSession, path, key, batch.schema, epoch)
            merged.write.mode("overwrite").parquet(f"{path}/base={epoch}")
            for base in _versions(path, "base")[-2:-1]:
                _drop_before(path, base)

    return write


_COOLED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("at", T.DoubleType())])
_LAST = T.StructType([T.StructField("last", T.DoubleType())])


def cooldown(events: DataFrame, seconds: float) -> DataFrame:
    """Events of a user at least ``seconds`` after the last one let through; within a micro-batch in order of time. State is a number a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])  # one user's rows of one micro-batch
        kept = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            if last is None or at - last >= seconds:
                last = at
                kept.append((key[0], event_id, at))
        state.update((last,))
        yield pd.DataFrame(kept, columns=["user_id", "event_id", "at"])

    timed = events.select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, _COOLED, _LAST, "append", GroupStateTimeout.NoTimeout)


_BUCKET_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType())])
_BUCKET = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last", T.DoubleType())])


def token_bucket(events: DataFrame, capacity: float, refill: float, cost: float = 1.0, burst: float = 0.0) -> DataFrame:
    """Whether each event of a user gets its tokens, in order of time within a micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            if last is not None:
                tokens = min(capacity + burst, tokens + (at - last) * refill)
            last = at
            ok = tokens >= cost
            tokens -= cost if ok else 0
            out.append((key[0], event_id, ok, float(tokens)))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "tokens"])

    timed = events.select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, _BUCKET_OUT, _BUCKET, "append", GroupStateTimeout.NoTimeout)
