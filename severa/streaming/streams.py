"""Structured Streaming forms of the scheduled jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Calls by key and day; late ones count until the watermark passes them."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day").alias("day")).agg(F.count("*").alias("calls"))


def settled_months(notices: DataFrame, ts: str, delay: str = "30 days") -> DataFrame:
    """Notices by 31-day bucket, given out when the settle delay has passed."""
    return notices.withWatermark(ts, delay).groupBy(F.window(ts, "31 days").alias("bucket")).agg(F.count("*").alias("notices"))


def first_seen(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once inside the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: Groups that a stream's keys are dealt into. A call for a group costs milliseconds, one for each key would be most of a run.
BUCKETS = 512


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows by bucket of their key; null keys have one of their own, below 0, and are 0 in it."""
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).cast("int")
    return rows.withColumn("bucket", bucket).withColumn("key", F.coalesce("key", F.lit(0)))


def _keys(bucket: int, keys: list[int]) -> pd.Series:
    return pd.Series(keys if bucket >= 0 else [None] * len(keys), dtype="Int64")


def _keep(state: GroupState, ends: dict[int, int]) -> list[int]:
    """The keys whose state has not ended (ms of event time) by the watermark; the next to end is the bucket's timer."""
    now = state.getCurrentWatermarkMs()
    kept = sorted(k for k, end in ends.items() if end > now)
    if kept:
        state.setTimeoutTimestamp(min(ends[k] for k in kept))
    elif state.exists:
        state.remove()
    return kept


def _limit_bucket(limit: int, seconds: float):
    """A sliding-window limiter by key: a request is allowed if fewer than `limit` allowed ones lie in the last `seconds`;
    rejected ones don't extend the window. State is a list of at most `limit` times by key, and goes when the watermark has
    passed the last of them by the window, as it can then refuse nothing."""

    def run(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], map(list, state.get[1]), strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            new = pd.concat(rows).sort_values(["key", "t", "event_id"])  # of one trigger
            allowed = []
            for key, t in zip(new["key"].tolist(), new["t"].tolist(), strict=True):
                times = held[key] = [x for x in held.get(key, ()) if x > t - seconds]
                allowed.append(len(times) < limit)
                if allowed[-1]:
                    times.append(t)
            yield pd.DataFrame({"key": _keys(bucket[0], new["key"].tolist()), "event_id": new["event_id"].to_numpy(), "allowed": allowed})
        kept = _keep(state, {k: int((max(times) + seconds) * 1000) + 1 for k, times in held.items() if times})
        if kept:
            state.update((kept, [held[k] for k in kept]))

    return run


def _limit_runs(limit: int, seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in the order of key and time: the window goes on from one to the next, and a new key empties it."""
        last, times = None, []
        for batch in batches:
            allowed = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").fill_null(float("nan")).to_pylist(), strict=True):
                times = [x for x in times if x > t - seconds] if key == last else []
                last = key
                allowed.append(len(times) < limit)
                if allowed[-1]:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(allowed, pa.bool_())], ["key", "event_id", "allowed"])

    return run


def limited(events: DataFrame, key: str, limit: int, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """events (key, event_id, t seconds) as a stream or a table -> key, event_id, allowed.

    A stream needs its triggers' rows in the order of time; a key's state lives as long as its window. Rows over `late`
    behind the newest of the triggers before are dropped, as are moments before 1970. In a table the window empties wherever
    a key pauses for `seconds`, so runs between pauses are dealt out and folded one after another, in the order of time."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("t").cast("double").alias("t"))
    if not events.isStreaming:
        by = Window.partitionBy("key").orderBy(F.asc_nulls_last("t"), "event_id")
        paused = F.coalesce((F.col("t") - F.lag("t").over(by) >= seconds).cast("int"), F.lit(0))
        runs = rows.withColumn("paused", paused).withColumn("run", F.sum("paused").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        dealt = runs.select("key", "run", "event_id", "t").repartition("key", "run").sortWithinPartitions("key", "run", F.asc_nulls_last("t"), "event_id")
        return dealt.select("key", "event_id", "t").mapInArrow(_limit_runs(limit, seconds), "key long, event_id long, allowed boolean")
    timed = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return _bucketed(timed).groupBy("bucket").applyInPandasWithState(_limit_bucket(limit, seconds), "key long, event_id long, allowed boolean", "keys array<long>, times array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def _anchor_bucket(gap: int):
    """Starts of events by key over days that arrive in order: state is the last start by key, and goes once the watermark
    has passed its gap, as any later day opens an event then."""

    def run(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, opened = dict(zip(*state.get, strict=True)) if state.exists else {}, []
        if not state.hasTimedOut:
            new = pd.concat(rows)[["key", "day"]].drop_duplicates().sort_values(["key", "day"])  # of one trigger
            for key, day in zip(new["key"].tolist(), new["day"].tolist(), strict=True):
                if key not in held or day > held[key] + gap:
                    held[key] = day
                    opened.append((key, day))
        if opened:
            yield pd.DataFrame({"key": _keys(bucket[0], [k for k, _ in opened]), "start": [d for _, d in opened]})
        kept = _keep(state, {k: (start + gap + 1) * 86_400_000 for k, start in held.items()})
        if kept:
            state.update((kept, [held[k] for k in kept]))

    return run


def anchored_events(rows: DataFrame, gap: int, late: str = "1 day") -> DataFrame:
    """(key, day, counted from 1970) as a stream -> key, start. A key's state lives as long as its event's gap."""
    timed = rows.select(F.col("key").cast("long").alias("key"), F.col("day").cast("int").alias("day"), F.timestamp_seconds(F.col("day").cast("long") * 86_400).alias("at")).withWatermark("at", late)
    return _bucketed(timed).groupBy("bucket").applyInPandasWithState(_anchor_bucket(gap), "key long, start int", "keys array<long>, days array<int>", "append", GroupStateTimeout.EventTimeTimeout)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_in_steps(slices: Iterable[DataFrame], stream: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Appends one slice after the other to a folder that a stream reads, and runs the stream over what is there until it
    has read all, each time from the checkpoint that the run before has left. Returns what the stream has written."""
    spark, before = None, None
    for i, rows in enumerate(slices):
        spark = rows.sparkSession
        before = spark.conf.get(_STORE, None) if i == 0 else before
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            rows.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            out = stream(source)
            run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
        finally:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run_log(sink, log):
    """A foreachBatch function that writes a batch once and logs how it ended: a batch id that the log has is skipped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if log.done(batch_id):
            return
        try:
            sink(batch)
        except Exception:
            log.add(batch_id, "failed")
            raise
        log.add(batch_id, "ok")

    return run
