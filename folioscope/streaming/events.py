"""Event streams (STR-01 to STR-03). The same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per event type and tumbling window; events later than ``late`` are passed over in a stream."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def step_durations(events: DataFrame, key: str = "user_id") -> DataFrame:
    """STR-02 in batch: seconds since the event before of the same key."""
    w = Window.partitionBy(key).orderBy("us", "event_id")
    x = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return x.select("event_id", key, (F.col("us") - F.lag("us").over(w)).alias("micros"))


def running_durations(events: DataFrame) -> DataFrame:
    """STR-02 in a stream: a state per key keeps the last event time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            out = []
            for t in pdf["ts"]:
                micros = int(pd.Timestamp(t).value // 1000)
                out.append(None if last is None else micros - last)
                last = micros
            yield pd.DataFrame({"user_id": [key[0]] * len(out), "micros": pd.array(out, dtype="Int64")})
        if last is not None:
            state.update((last,))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, micros bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """STR-01: new files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def sink(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """STR-03: run ``each`` on every micro-batch, resumable by its checkpoint."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
