"""Queries that run the tables as streams, stopped and started again, with the SQL of the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from ..sources.state_log import StateLog
from ..streaming import events, state
from .catalog import _SQL, query, readings
from .features_catalog import session_counts, windowed_counts  # noqa: F401
from .retrieval_catalog import state_history  # noqa: F401

#: Micro-batches' arrivals, and the least partitions of the streams' state, few as their workers start anew with each.
SLICES, PARTITIONS = 2, 4


@query(_SQL["state_history"])
def stream_state_history(spark: SparkSession, d: str) -> DataFrame:
    """The state before and after each event from a stateful stream."""
    e = readings(spark, d).select("patient_id", "timestamp", "event_id", "channel", F.col("glucose").alias("g"), F.when(F.col("event_id") % 4 != 0, F.col("glucose")).alias("c"))
    job = lambda s: state.state_changes(s, "patient_id", "timestamp", "event_id", {"current_glucose": "g", "carbs_on_board": "c"}, {"current_glucose": F.col("channel") == "view", "carbs_on_board": F.col("channel") == "click"})
    out = state.replay(e, state.spans(e, "timestamp", SLICES), SLICES, job, partitions=PARTITIONS)
    return out.select(F.col("seq").alias("event_id"), "current_glucose", "carbs_on_board", F.col("previous_current_glucose").alias("previous_glucose"))


@query(_SQL["windowed_counts"])
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the stream gives as they close."""
    e = state.with_end(readings(spark, d).drop("props"), "timestamp")
    out = state.replay(e, state.spans(e, "timestamp", SLICES), SLICES, lambda s: events.windowed(s, "timestamp", "channel", "glucose"), partitions=PARTITIONS)
    return out.where("channel is not null").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "channel", "n", F.round("total", 4).alias("total"))


@query(_SQL["session_counts"])
def stream_session_counts(spark: SparkSession, d: str) -> DataFrame:
    e = state.with_end(readings(spark, d).drop("props"), "timestamp")
    out = state.replay(e, state.spans(e, "timestamp", SLICES), SLICES, lambda s: events.sessions(s, "timestamp", "patient_id"), partitions=PARTITIONS)
    return out.where("patient_id is not null").select("patient_id", "n")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT *, event_type = 'view' OR (event_type = 'error' AND rn = 1) AS wg, event_type = 'click' AS wc, event_type IN ('view', 'click') OR rn = 1 AS wt FROM e),
s AS (SELECT patient_id, arg_max(value, rn) FILTER (WHERE wg) AS g, arg_max(struct_pack(v := CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END), rn) FILTER (WHERE wc) AS c, arg_max(ts, rn) FILTER (WHERE wt) AS t,
count(*) FILTER (WHERE event_type <> 'error' OR rn = 1) + max(CASE WHEN rn = 1 AND event_type <> 'error' THEN 1 ELSE 0 END) AS version FROM k GROUP BY patient_id)
SELECT patient_id, CAST(version AS BIGINT) AS version, coalesce(g, 100.0) AS current_glucose, CASE WHEN c IS NULL THEN 0.0 ELSE c.v END AS carbs_on_board, CAST(5 AS INT) AS stress_level, strftime(t, '%Y-%m-%d %H:%M:%S') AS at FROM s""")
def state_from_log(spark: SparkSession, d: str) -> DataFrame:
    """States read from a snapshot and the tail of the log: creates, updates, interventions and other events of all patients."""
    value = F.col("glucose").cast("string")
    kind = F.when(F.col("channel").isin("view", "click"), "update").when(F.col("channel") == "error", "create").when(F.col("channel") == "purchase", "intervention").otherwise("simulation")
    payload = F.when(F.col("channel").isin("view", "error"), F.create_map(F.lit("current_glucose"), value)).when(F.col("channel") == "click", F.create_map(F.lit("carbs_on_board"), F.when(F.col("event_id") % 4 != 0, value)))
    e = readings(spark, d).select("patient_id", "timestamp", "event_id", kind.alias("event_type"), payload.alias("payload"))
    log, span = StateLog(spark, scratch_dir(spark, "state-log")), state.spans(e, "timestamp", 3)
    for i in range(3):
        log.append(e.where(span == i), ["event_id"])
        if i == 1:
            log.snapshot()
    return log.states().select("patient_id", "version", "current_glucose", "carbs_on_board", "stress_level", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))
