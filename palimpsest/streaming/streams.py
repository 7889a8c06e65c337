"""Structured Streaming: deduplicated ingest, windowed quotas, gap sessions, and a stateful versioned writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.session import scratch_dir


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the files of a parquet table."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    import os

    if os.path.isfile(path.removeprefix("file://")):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder, and return that table.

    The folder also holds the stream's checkpoint, so that a lost executor or driver resumes without repeats.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, no: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={no}")

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first delivery of each key; state is kept for the watermark's delay."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def window_quota(stream: DataFrame, keys: list[str], at: str, width: str, slide: str, late: str) -> DataFrame:
    """Events per key and sliding window, emitted when the watermark has passed a window."""
    return stream.withWatermark(at, late).groupBy(*keys, F.window(at, width, slide)).agg(F.count(F.lit(1)).alias("events"))


def gap_sessions(stream: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions of events of a key that follow each other within a gap."""
    return stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("events"))


VERSION_STATE = "value string, at timestamp, trust double"
VERSION_OUT = "key string, value string, at timestamp, action string"


def versioned_writes(stream: DataFrame) -> DataFrame:
    """(key, value, at, action) for writes (key, value, at, trust), one key's state at a time.

    The first value of a key is an 'insert', an equal one a 'repeat'. Another value is an 'update' if it is not older
    and not less trusted (by more than 0.05) than the held one, else it goes to 'review' and changes nothing: a late
    correction never overwrites a newer value. Rows of one key within a batch are taken in order of time and value.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "value"], kind="stable")
        out = []
        for value, at, trust in rows[["value", "at", "trust"]].itertuples(index=False, name=None):
            if held is None:
                action, held = "insert", (value, at, trust)
            elif value == held[0]:
                action, held = "repeat", (value, max(at, held[1]), max(trust, held[2]))
            elif at >= held[1] and trust >= held[2] - 0.05:
                action, held = "update", (value, at, trust)
            else:
                action = "review"
            out.append((key[0], value, at, action))
        state.update(held)
        yield pd.DataFrame(out, columns=["key", "value", "at", "action"])

    return stream.groupBy("key").applyInPandasWithState(fold, VERSION_OUT, VERSION_STATE, "append", GroupStateTimeout.NoTimeout)
