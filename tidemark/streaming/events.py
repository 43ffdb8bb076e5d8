"""Streams of events: windowed counts with late data, and a running patient state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, ts: str, by: str, value: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, ts: str, by: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, by: str, ts: str, columns: list[str]) -> DataFrame:
    """The newest value of each column; in update mode each batch returns the patients it touched."""
    return events.groupBy(by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns], F.count("*").alias("n_events"))


def score_batches(stream: DataFrame, score, path: str, checkpoint: str) -> None:  # noqa: ANN001
    """Write ``score`` of each micro-batch (a function of DataFrames) to a folder of its own below ``path``, over what a failed try left."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table in memory; for results of a few rows a key."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
