"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: The state store that operators with state variables and timers need; ``turnwise.session`` sets it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; the checkpoint keeps what was processed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums of windows over event time, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def hopping_counts(events: DataFrame, length: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions closed by a gap in a key's events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_arrivals(rows: DataFrame, key: str, late: str) -> DataFrame:
    """Rows of keys not seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def streaming_ema(events: DataFrame, key: str, alpha: float = 0.1, forget: str | None = None) -> DataFrame:
    """(key, n, ema): the moving average of each key after a batch, its state kept between batches.

    Rows of a batch count in order of (ts, event_id). With ``forget`` (events then
    need a watermark on ``ts``) a key's state goes once the watermark is that far past
    its last event, so keys that stay away cost nothing; a key that returns begins anew.
    The session must have ``STATE_STORE``.
    """
    kind = dict(events.dtypes)[key]
    forget_ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    with_state = {"outputStructType": f"{key} {kind}, n long, ema double", "outputMode": "Update", "timeMode": "None" if forget is None else "EventTime"}
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=MovingAverage(key, alpha, forget_ms), **with_state)


class MovingAverage(StatefulProcessor):
    def __init__(self, key: str, alpha: float, forget_ms: int | None):
        self.key, self.alpha, self.forget_ms = key, alpha, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("ema", "n long, ema double, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, value, due = self.state.get() if self.state.exists() else (0, None, 0)
        every = pd.concat(rows).sort_values(["ts", "event_id"])
        for x in every["value"]:
            value = float(x) if value is None else self.alpha * float(x) + (1 - self.alpha) * value
        n += len(every)
        if self.forget_ms is not None:
            after = max(due, int(every["ts"].max().timestamp() * 1000) + self.forget_ms)
            if due and after != due:
                self.handle.deleteTimer(due)
            if after != due:
                self.handle.registerTimer(after)
            due = after
        self.state.update((n, value, due))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "ema": [value]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write it as Parquet, and end."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
