"""Running metrics over a stream of events; an extension, with Spark's own state and watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events (event_id, ts, user_id, event_type, value, props) as files arrive."""
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_means(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean) by windows of event time; later events than ``late`` don't count."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def running_accuracy(rows: DataFrame, ignored: str) -> DataFrame:
    """(model, accuracy, n) over all rows (model, gold, pred) of a stream so far."""
    right, counted = F.sum((F.col("gold") == F.col("pred")).cast("int")), F.sum((F.col("gold") != ignored).cast("int"))
    return rows.groupBy("model").agg(F.when(counted > 0, right / counted).otherwise(0.0).alias("accuracy"), F.count("*").alias("n"))


def step_means(rows: DataFrame, every: int) -> DataFrame:
    """(model, step, n, mean) of a stream of rows (model, place, value): the mean of each ``every`` rows of a model in order of place, after which it starts anew; steps count from 0, and the last one comes when it is full.

    What is kept for a model is a step's number, count and sum. Rows of a model go by in order within a
    micro-batch, whose rows of one model are held together; of batches, those that come first count
    first. Null values count as rows, not in the mean; a step of nulls only has a null mean.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, n, known, total = state.get if state.exists else (0, 0, 0, 0.0)
        held = pd.concat(list(frames)).sort_values("place", kind="stable")
        out = []
        for value in held.value.tolist():
            n += 1
            if value is not None and value == value:
                known, total = known + 1, total + value
            if n == every:
                out.append((key[0], step, n, total / known if known else None))
                step, n, known, total = step + 1, 0, 0, 0.0
        state.update((step, n, known, total))
        yield pd.DataFrame(out, columns=["model", "step", "n", "mean"]).astype({"step": "int64", "n": "int64", "mean": "float64"})

    kind = dict(rows.dtypes)["model"]
    grouped = rows.select("model", "place", F.col("value").cast("double").alias("value")).groupBy("model")
    return grouped.applyInPandasWithState(count, f"model {kind}, step long, n long, mean double", "step long, n long, known long, total double", "append", "NoTimeout")


def all_available(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """What a stream gives for all that is there now, written to ``out`` and read back; ``checkpoint`` is where it goes on from next time."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
