"""Queries written in SQL alone, over the functions of :mod:`tidemark.functions.sql`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register
from .catalog import _SQL, query

_EVENTS = "e AS (SELECT CAST(user_id AS STRING) AS patient_id, event_id, ts, value FROM parquet.`{d}/events.parquet`)"


@query(_SQL["patient_state"])
def sql_patient_state(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    return spark.sql(f"""
        WITH {_EVENTS.format(d=d)},
        f AS (SELECT event_id, value AS p, lead(value, 6) OVER (PARTITION BY patient_id ORDER BY ts, event_id) AS y FROM e),
        s AS (SELECT event_id, y, y - p AS change, glucose_risk(y) AS risk, CAST(1 + event_id % 10 AS INT) AS stress FROM f WHERE y IS NOT NULL)
        SELECT event_id, glucose_trend(change) AS trend, glucose_pace(change) AS pace, risk, risk_urgency(risk, glucose_pace(change), stress) AS urgency,
            array_join(expected_conditions(risk, y - 20, y + 20), ',') AS conditions
        FROM s""")


@query(_SQL["dose_search"])
def sql_dose_search(spark: SparkSession, d: str) -> DataFrame:
    """The dose grid of a table function, joined laterally to every patient."""
    register(spark)
    return spark.sql(f"""
        WITH {_EVENTS.format(d=d)},
        b AS (SELECT patient_id, round(avg(value) + 60, 3) AS g, count(*) AS n FROM e GROUP BY patient_id),
        s AS (SELECT patient_id, least(400D, greatest(40D, g)) AS glucose, n % 3 AS insulin, n % 40 AS carbs, least(10, greatest(1, n % 12)) AS stress, n % 50 AS activity FROM b),
        t AS (SELECT patient_id, i, glucose_after(glucose, insulin + dose, carbs + 30, stress, activity, 120) AS projected FROM s, LATERAL dose_grid(30D, 20))
        SELECT patient_id, round(min_by(projected, struct(abs(projected - 120), i)), 6) AS dose_projected, min_by(i, struct(abs(projected - 120), i)) AS i FROM t GROUP BY patient_id""")


@query(_SQL["chunk_words"])
def sql_chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """Chunks from a table function that gets each document in its partition."""
    register(spark)
    return spark.sql(f"SELECT doc_id, pos, md5(chunk) AS h FROM chunk_words(TABLE(SELECT doc_id, text FROM parquet.`{d}/documents.parquet`) PARTITION BY (doc_id), 900, 120)")


@query("""WITH r AS (SELECT event_id, value AS p, least(600.0, greatest(20.0, value * 4)) AS y, 1 + event_id % 10 AS stress FROM events), c AS (SELECT *, round_even(y - least(600.0, greatest(20.0, p)), 2) AS d FROM r),
k AS (SELECT *, CASE WHEN y < 54 THEN 'BAHAYA - Hipoglikemia Berat' WHEN y < 70 THEN 'BAHAYA - Hipoglikemia' WHEN y > 250 THEN 'BAHAYA - Hiperglikemia Berat' WHEN y > 180 THEN 'HATI-HATI - Hiperglikemia' ELSE 'AMAN' END AS name FROM c)
SELECT name, CASE WHEN y < 54 OR y > 250 THEN 'critical' WHEN y < 70 OR y > 180 OR abs(d) >= 30 THEN 'high' WHEN stress >= 8 THEN 'medium' ELSE 'low' END AS urgency, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2""")
def sql_outlook(spark: SparkSession, d: str) -> DataFrame:
    """How many readings have which outlook, by a table function of SQL functions."""
    register(spark)
    return spark.sql(f"SELECT o.name, o.urgency, count(*) AS n FROM parquet.`{d}/events.parquet` e, LATERAL patient_outlook(e.value, e.value * 4, CAST(1 + e.event_id % 10 AS INT)) o GROUP BY o.name, o.urgency")
