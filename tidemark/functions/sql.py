"""The rules as SQL functions: expressions that the optimizer sees, table functions, and a Python table function for chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .rules import RISK_NAMES

#: Name and parameters, result, body. Functions may use those before them.
FUNCTIONS = [
    ("glucose_in_range(x DOUBLE)", "DOUBLE", "CASE WHEN x IS NOT NULL THEN least(600D, greatest(20D, x)) END"),
    ("glucose_zone(x DOUBLE)", "STRING", "CASE WHEN x < 70 THEN 'hypo' WHEN x > 180 THEN 'hyper' ELSE 'normal' END"),
    ("glucose_error_zone(truth DOUBLE, predicted DOUBLE)", "STRING", "CASE WHEN truth IS NULL OR predicted IS NULL THEN NULL WHEN (truth < 70 AND predicted < 70) OR abs(truth - predicted) <= 0.2D * truth THEN 'A' WHEN truth BETWEEN 70 AND 180 AND predicted BETWEEN 70 AND 180 THEN 'B' WHEN (truth < 70 AND predicted > 180) OR (truth > 180 AND predicted < 70) THEN 'C' WHEN predicted BETWEEN 70 AND 180 THEN 'D' ELSE 'E' END"),
    ("glucose_trend(change DOUBLE)", "STRING", "CASE WHEN abs(change) < 10 THEN 'stable' WHEN change > 0 THEN 'rising' ELSE 'falling' END"),
    ("glucose_pace(change DOUBLE)", "STRING", "CASE WHEN abs(change) >= 30 THEN 'rapid' WHEN abs(change) >= 10 THEN 'moderate' ELSE 'slow' END"),
    ("glucose_risk(predicted DOUBLE)", "STRING", "CASE WHEN predicted < 54 THEN 'critical_hypoglycemia' WHEN predicted < 70 THEN 'hypoglycemia' WHEN predicted > 250 THEN 'critical_hyperglycemia' WHEN predicted > 180 THEN 'hyperglycemia' ELSE 'normal' END"),
    ("risk_name(risk STRING)", "STRING", "CASE risk " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RISK_NAMES.items()) + " END"),
    ("risk_with_class(risk STRING, label STRING)", "STRING", "CASE WHEN risk LIKE 'critical%' THEN risk WHEN label = 'hypo' THEN 'hypoglycemia' WHEN label = 'hyper' THEN 'hyperglycemia' WHEN label = 'normal' THEN 'normal' ELSE risk END"),
    ("expected_conditions(risk STRING, lower DOUBLE, upper DOUBLE)", "ARRAY<STRING>", "filter(array(CASE WHEN risk IN ('hypoglycemia', 'critical_hypoglycemia') OR lower < 70 THEN 'hypoglycemia' END, CASE WHEN risk IN ('hyperglycemia', 'critical_hyperglycemia') OR upper > 180 THEN 'hyperglycemia' END, CASE WHEN risk = 'normal' THEN 'normal' END), c -> c IS NOT NULL)"),
    ("risk_urgency(risk STRING, pace STRING, stress INT)", "STRING", "CASE WHEN risk LIKE 'critical%' THEN 'critical' WHEN risk IN ('hypoglycemia', 'hyperglycemia') OR pace = 'rapid' THEN 'high' WHEN stress >= 8 THEN 'medium' ELSE 'low' END"),
    ("glucose_warning(label STRING, predicted DOUBLE, lower DOUBLE)", "STRING", "CASE WHEN label = 'hypo' AND predicted >= 70 THEN 'A' WHEN lower < 70 AND predicted >= 70 THEN 'B' END"),
    ("insulin_on_board(hours DOUBLE, dose DOUBLE)", "DOUBLE", "CASE WHEN hours >= 4 THEN 0D ELSE dose * exp(-ln(2D) / 2 * hours) END"),
    ("carbs_on_board(hours DOUBLE, carbs DOUBLE)", "DOUBLE", "CASE WHEN hours >= 3 THEN 0D ELSE greatest(0D, carbs - carbs / 3 * hours) END"),
    ("glucose_after(glucose DOUBLE, insulin DOUBLE, carbs DOUBLE, stress DOUBLE, activity DOUBLE, minutes DOUBLE)", "DOUBLE", "CASE WHEN glucose + (-insulin * 50 + carbs * 3 + stress * 2 - activity * 1.5D) * minutes / 60 IS NOT NULL THEN least(400D, greatest(40D, glucose + (-insulin * 50D + carbs * 3D + stress * 2D - activity * 1.5D) * minutes / 60)) END"),
]
#: Functions that return rows.
TABLES = [
    ("dose_grid(carbs DOUBLE, points INT)", "i INT, dose DOUBLE", "SELECT CAST(i AS INT), carbs / 10 * (0.5D + i / (points - 1D)) FROM explode(sequence(0, points - 1)) AS t(i)"),
    ("patient_outlook(current DOUBLE, predicted DOUBLE, stress INT)", "trend STRING, pace STRING, risk STRING, name STRING, urgency STRING", "SELECT glucose_trend(change), glucose_pace(change), risk, risk_name(risk), risk_urgency(risk, glucose_pace(change), stress) FROM (SELECT bround(glucose_in_range(predicted) - glucose_in_range(current), 2) AS change, glucose_risk(glucose_in_range(predicted)) AS risk)"),
]


def _chunker() -> type:
    class WordChunks:
        """``doc_id, pos, chunk`` of each row's text: ``size`` words every ``size - overlap``."""

        def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
            words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", row["text"] or "") if w]
            for pos, at in enumerate(range(0, len(words), max(size - overlap, 1))):
                yield row["doc_id"], pos, " ".join(words[at : at + size])

    return udtf(WordChunks, returnType="doc_id bigint, pos int, chunk string")


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL (``chunk_words(TABLE(...) PARTITION BY (doc_id), size, overlap)`` among them)."""
    for name, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {result} RETURN {body}")
    for name, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS TABLE({result}) RETURN {body}")
    spark.udtf.register("chunk_words", _chunker())
