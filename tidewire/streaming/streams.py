"""Structured Streaming forms of the collection and telemetry semantics."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.runtime import keep, scratch_root


def in_batches(rows: DataFrame, files: int) -> DataFrame:
    """A table as a stream of `files` batches, each of one span of time. They come in the order in which their files were finished, so any of them may be late."""
    spark = rows.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    keep(spark, root)
    rows.repartitionByRange(files, "ts").write.parquet(f"{root}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry_rollup(events: DataFrame, window: str = "1 day", lateness: str = "8 hours") -> DataFrame:
    """Calls, tokens and time per stage and tumbling window."""
    late = events.withWatermark("ts", lateness) if events.isStreaming else events
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    rolled = late.groupBy(F.window("ts", window), F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.round(F.sum("value"), 2).alias("duration"))
    return rolled.select(F.col("window.start").alias("day"), "stage", "calls", "tokens", "duration")


def sliding_counts(events: DataFrame, width: str = "48 hours", slide: str = "24 hours") -> DataFrame:
    """Events per sliding window."""
    late = events.withWatermark("ts", "8 hours") if events.isStreaming else events
    return late.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of a user's activity."""
    late = events.withWatermark("ts", "8 hours") if events.isStreaming else events
    s = late.groupBy(F.session_window("ts", gap), F.col("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")


def distinct_within(events: DataFrame, keys: list[str], lateness: str = "8 hours") -> DataFrame:
    """First row per key within the lateness bound. Rows behind the watermark are lost; where none may be, append_new() is the form."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def append_new(path: str, keys: list[str]):
    """A foreachBatch sink that appends rows of unseen keys to a Parquet table, so keys are unique forever, with no state in the stream.

    Each batch has a folder of its own, named by its number: a batch that is run again is held against the other ones and
    overwrites its own, so its rows stand there once however often it fails. Read the table with read_appended().
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        before = [f for n, f in _batches(spark, path) if n != epoch]
        if before:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(*before).select(*keys), keys, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return write


def _batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the batches that are whole."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return []
    folders = [f.getPath() for f in fs.listStatus(there) if f.getPath().getName().startswith("batch=")]
    return [(int(p.getName().removeprefix("batch=")), p.toString()) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table that append_new() wrote."""
    folders = [f for _, f in _batches(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def appended(stream: DataFrame, keys: list[str]) -> DataFrame:
    """What an available-now run of the stream leaves in a new table of append_new()."""
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    keep(spark, root)
    query = stream.writeStream.foreachBatch(append_new(f"{root}/out", keys)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_appended(spark, f"{root}/out", stream.schema)


STATE = "seen bigint, state string"


def lifecycle_state(events: DataFrame, key: str = "user_id", idle: str | None = None, lateness: str = "8 hours") -> DataFrame:
    """Emerging, developing, stabilized per key by the number of events so far.

    With `idle` (hours, as a number), a key that is silent so long behind the watermark is forgotten, so the state holds the
    active keys only; without it keys are remembered forever.
    """
    wait = None if idle is None else int(float(idle) * 3_600_000)
    rows = events if wait is None else events.withWatermark("ts", lateness)

    def step(keys: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get[0] if state.exists else 0, 0
        for pdf in batches:
            seen += len(pdf)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        name = "emerging" if seen < 3 else "developing" if seen < 10 else "stabilized"
        state.update((seen, name))
        if wait is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({key: [keys[0]], "seen": [seen], "state": [name]})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    return rows.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} bigint, seen bigint, state string", STATE, "update", timeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What an available-now run of the query puts out, through Parquet files in the shared folder: rows (append), the last state (complete), or every update."""
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    keep(spark, root)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(f"{root}/out")
    if mode != "complete":
        return rows.drop("batch")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def young(events: DataFrame, now, hours: int) -> DataFrame:
    """Rows not older than the mode's age, which is also the stream's lateness bound."""
    late = events.withWatermark("ts", f"{hours} hours") if events.isStreaming else events
    return late.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))


def retried(send, attempts: int = 3, pause: float = 300.0, sleep=None) -> int:
    """Calls `send` until it doesn't raise, `attempts` times at most, a pause between; returns the number of calls."""
    import time

    for k in range(1, attempts + 1):
        try:
            send()
            return k
        except Exception:
            if k == attempts:
                raise
            (sleep or time.sleep)(pause)
    return 0


def stage_totals(calls: DataFrame, window: str = "1 day", lateness: str = "8 hours") -> DataFrame:
    """Per stage and day of (ts, stage, status, prompt, cached, completion): calls, failures, tokens by kind, and the share of prompt tokens from the cache."""
    late = calls.withWatermark("ts", lateness) if calls.isStreaming else calls
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    g = late.groupBy(F.window("ts", window), "stage").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failures"), total("prompt").alias("prompt"), total("cached").alias("cached"), total("completion").alias("completion"))
    share = F.when(F.col("prompt") > 0, F.round(F.col("cached") / F.col("prompt"), 4)).otherwise(F.lit(0.0))
    return g.select(F.col("window.start").alias("day"), "stage", "calls", "failures", "prompt", "cached", "completion", share.alias("cache_share"))
