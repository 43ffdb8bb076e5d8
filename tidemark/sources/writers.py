"""Sinks; appends and overwrites rely on Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_readings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("patient_id").parquet(path)


def append_entry(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_states(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def flat_metadata(df: DataFrame, column: str) -> DataFrame:
    """Metadata struct fields as scalars; arrays joined by commas."""
    fields = df.schema[column].dataType.fields
    plain = [F.array_join(F.col(f"{column}.{f.name}"), ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f"{column}.{f.name}").cast("string").alias(f.name) for f in fields]
    return df.withColumn(column, F.struct(*plain))


def write_vectors(df: DataFrame, path: str, reset: bool = True) -> None:
    df.write.mode("overwrite" if reset else "append").parquet(path)


def write_chunks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as JSON lines."""
    df.write.mode(mode).json(path)


def write_twins(df: DataFrame, path: str, by: str = "patient_id") -> None:
    """States as JSON in a folder a patient, with the id in the records too."""
    df.withColumn("patient", F.col(by)).repartition(by).write.mode("overwrite").partitionBy("patient").json(path)
