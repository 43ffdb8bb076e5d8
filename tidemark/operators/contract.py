"""The reading table's contract: required and optional columns, coercion, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ["patient_id", "timestamp", "glucose", "carbs", "insulin", "activity"]
DEFAULTS = {"stress": 0.0, "sleep": 0.0, "work": 0.0, "illness": 0.0, "glucose_change": 0.0, "meal_type": "none", "source": "unknown"}
NUMERIC = ["glucose", "carbs", "insulin", "activity", "stress", "sleep", "work", "illness", "glucose_change"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def validate(df: DataFrame, required: list[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """Coerce types, add missing optional columns, drop rows without patient or time.

    Numbers that do not parse and NaN become null. Defaults fill missing columns only; a null ``meal_type`` becomes
    ``none``. Other columns pass through.
    """
    require(df, REQUIRED if required is None else required)
    for name, value in (DEFAULTS if defaults is None else defaults).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    made = {"patient_id": F.col("patient_id").cast("string")}
    kind = dict(df.dtypes)["timestamp"]
    made["timestamp"] = F.try_to_timestamp("timestamp") if kind == "string" else F.col("timestamp").cast("timestamp")
    for name in NUMERIC:
        if name in df.columns:
            number = F.expr(f"try_cast(`{name}` AS double)")
            made[name] = F.when(~F.isnan(number), number)
    if "meal_type" in df.columns:
        made["meal_type"] = F.coalesce(F.col("meal_type").cast("string"), F.lit("none"))
    return df.withColumns(made).dropna(subset=["patient_id", "timestamp"])


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose numbers are all present and finite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def null_counts(df: DataFrame) -> DataFrame:
    return df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
