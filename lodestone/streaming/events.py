"""Structured Streaming twins of the event queries: counters, first touch, funnel, dedup and error backoff."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder; ``ts`` becomes a timestamp with zone, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counters(events: DataFrame, unit: str, late: str = "1 hour") -> DataFrame:
    """Requests per model and calendar window of a unit; windows close once the watermark passes them."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", unit), F.col("user_id").alias("model_id")).agg(F.count("*").alias("requests"))
    return windowed.select("model_id", F.col("window.start").alias("start"), "requests")


def first_touch(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first arriving event of each user within the watermark; input in order of time gives first-touch."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])


def funnel(events: DataFrame) -> DataFrame:
    """Running counts per user, for update or complete mode."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "signup").alias("signups"), F.count_if(kind == "purchase").alias("purchases"))


#: Seconds that the first, second and any later error in a row block a model.
BLOCK_SECONDS = (15, 30, 60)


def backoff(events: DataFrame) -> DataFrame:
    """Per error: how many in a row the model has had, and until when it is blocked; a success starts anew.

    The state of a model is its count of errors in a row. Events of a batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, kind in zip(rows["event_id"], rows["ts"], rows["event_type"]):
            if kind != "error":
                errors = 0
                continue
            errors += 1
            out.append((event_id, errors, ts + pd.Timedelta(seconds=BLOCK_SECONDS[min(errors, 3) - 1])))
        state.update((errors,))
        yield pd.DataFrame(out, columns=["event_id", "consecutive", "blocked_until"])

    keyed = events.withColumn("model_id", F.col("user_id"))
    return keyed.groupBy("model_id").applyInPandasWithState(step, "event_id long, consecutive long, blocked_until timestamp", "errors long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all files that are there and return what the memory sink holds."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
