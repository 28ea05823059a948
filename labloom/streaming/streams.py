"""Streams: idempotent ingest, progress, windows with late data, rate limits with state, audit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def folder_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, glob: str = "*") -> DataFrame:
    """New parquet files of a landing folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def idempotent(stream: DataFrame, key: str, time: str, keep: str = "7 days") -> DataFrame:
    """The first row of each key; keys are remembered for ``keep`` beyond the watermark, so state is bounded."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def progress(stream: DataFrame, key: str, step: str, time: str) -> DataFrame:
    """The latest step of each key (update mode)."""
    return stream.groupBy(key).agg(F.max_by(step, time).alias(step), F.max(time).alias(time), F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window; rows later than ``late`` are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def rate_limited_stream(stream: DataFrame, key: str, time: str, tie: str, most: int = 20, window_s: int = 300) -> DataFrame:
    """Events with whether they were allowed: at most ``most`` allowed ones of a key in ``window_s`` seconds. State: the last allowed times of each key."""
    fields = {f.name: f.dataType.simpleString() for f in stream.select(key, time, tie).schema}

    def run(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([time, tie])
        marks = []
        for at in rows[time].astype("datetime64[us]").astype("int64"):
            held = [h for h in held if at - h <= window_s * 1_000_000]
            marks.append(len(held) < most)
            if marks[-1]:
                held.append(at)
        state.update((held,))
        yield rows[[key, time, tie]].assign(allowed=marks)

    out = ", ".join(f"`{k}` {t}" for k, t in fields.items()) + ", allowed boolean"
    return stream.select(key, time, tie).groupBy(key).applyInPandasWithState(run, out, "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what there is to parquet and ends."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Hands every batch to ``sink`` with its number (a repeated number is a retry) and ends."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
