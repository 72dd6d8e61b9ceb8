"""The temporal operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of event files; their times are taken as UTC."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """``start``, ``by``, ``n``, ``total`` of each window, final once it can't change."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """``by``, ``start``, ``end``, ``n``: session windows, merged by the engine."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def kalman(events: DataFrame, by: str = "user_id", process: float = 0.1, noise: float = 0.5) -> DataFrame:
    """``by``, ``n``, ``estimate``, ``variance`` after each batch: a scalar filter
    whose state is kept for each key; values of a batch are taken in order of time."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, x, p = state.get if state.exists else (0, 0.0, 1.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        for z in rows["value"].tolist():
            if n == 0:
                x = z
            else:
                p += process
                g = p / (p + noise)
                x, p = x + g * (z - x), (1 - g) * p
            n += 1
        state.update((n, x, p))
        yield pd.DataFrame({by: [key[0]], "n": [n], "estimate": [x], "variance": [p]})

    kind = events.schema[by].dataType.simpleString()
    return events.where("value is not null").select(by, "ts", "value").groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, n long, estimate double, variance double", "n long, x double, p double", "update", "NoTimeout")


def with_profile(events: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """Events with the columns of a static table: a stream-static left join."""
    return events.join(table, by, "left")


def into(stream: DataFrame, apply, checkpoint: str):
    """Each batch handed to ``apply(batch, number)``: what triggers on new data do."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
