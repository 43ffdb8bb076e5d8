"""Patients' states as an append-only log of events with snapshots.

Every event has its patient's version, counted from 1. A state is the newest snapshot with the tail of the log folded in, so a read
costs the tail, not the history. Appends work on whole batches of events of any number of patients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.twin import state_history
from .commits import Commits
from .scratch import delete, exists

#: The keys of a state, their types and defaults. Each event that writes sets ``timestamp`` too.
KEYS = {"current_glucose": ("double", 100.0), "insulin_on_board": ("double", 0.0), "carbs_on_board": ("double", 0.0), "last_meal_time": ("timestamp", None), "last_insulin_time": ("timestamp", None), "activity_level": ("int", 0), "stress_level": ("int", 5), "timestamp": ("timestamp", None)}
EVENTS = "patient_id string, version long, event_type string, payload map<string,string>, timestamp timestamp"
STATES = "patient_id string, version long, " + ", ".join(f"{k} {kind}" for k, (kind, _) in KEYS.items())


def written(key: str) -> Column:
    """Whether an event writes a key: a create writes all, an update those in its payload and the time, others none."""
    update = F.lit(True) if key == "timestamp" else F.map_contains_key("payload", F.lit(key))
    return (F.col("event_type") == "create") | ((F.col("event_type") == "update") & update)


def value_of(key: str) -> Column:
    """What an event writes: the payload's value, or in a create without one the default; a payload's null stays null."""
    kind, default = KEYS[key]
    given = F.element_at("payload", F.lit(key)).cast(kind)
    if key == "timestamp":
        return F.when(F.col("event_type") == "create", F.coalesce(given, F.col("timestamp"))).otherwise(F.col("timestamp"))
    return F.when(F.map_contains_key("payload", F.lit(key)), given).otherwise(F.lit(default).cast(kind))


class StateLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    # reading

    def _parts(self, upto: int | None = None) -> tuple[int, list[int]]:
        """The number of the newest snapshot (0 for none), and of the appends after it."""
        newest = self.commits.newest() if upto is None else upto
        manifest = self.commits.read(newest) if newest else {"snapshot": 0}
        snapshot = manifest["snapshot"]
        return snapshot, [n for n in range(snapshot + 1, newest + 1) if n != snapshot]

    def _read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def states(self, upto: int | None = None) -> DataFrame:
        """The state of every patient, now or after the commit ``upto``, and the ``version`` of its newest event."""
        snapshot, tail = self._parts(upto)
        held = self._read("snapshots", [snapshot] if snapshot else [], STATES)
        if not tail:
            return held
        events = self._read("log", tail, EVENTS)
        at = F.col("version")
        folded = events.groupBy("patient_id").agg(F.max("version").alias("_version"), *[F.max_by(F.when(written(k), F.struct(value_of(k).alias("v"))), F.when(written(k), at)).alias(f"_{k}") for k in KEYS])
        joined = held.join(folded, "patient_id", "full")
        return joined.select("patient_id", F.coalesce("_version", "version").alias("version"), *[F.when(F.col(f"_{k}").isNotNull(), F.col(f"_{k}.v")).otherwise(F.col(k)).alias(k) for k in KEYS])

    def state(self, patient_id: str) -> Row:
        """One patient's state; a KeyError if there is none."""
        found = self.states().where(F.col("patient_id") == patient_id).first()
        if found is None:
            raise KeyError(f"no state of patient {patient_id}")
        return found

    def patients(self) -> DataFrame:
        return self.states().select("patient_id").orderBy("patient_id")

    def events(self) -> DataFrame:
        """All events, with ``previous``, the state before each."""
        newest = self.commits.newest()
        numbers = [n for n in range(1, newest + 1) if self.commits.read(n)["snapshot"] != n]
        raw = self._read("log", numbers, EVENTS).withColumns({f"v_{k}": value_of(k) for k in KEYS}).withColumnRenamed("timestamp", "at")
        raw = raw.withColumns({f"w_{k}": F.lit(True) & written(k) for k in KEYS})
        out = state_history(raw, "patient_id", ["version"], {k: f"v_{k}" for k in KEYS}, {k: F.col(f"w_{k}") for k in KEYS})
        return out.select("patient_id", "version", "event_type", "payload", F.col("at").alias("timestamp"), "previous")

    # writing

    def append(self, events: DataFrame, order: list[str] | None = None) -> int:
        """Append ``patient_id, event_type, payload, timestamp`` in order of time, then ``order``; returns the commit's number.

        A patient's first event is a create: one with the defaults comes first where the batch has none, and a create of a
        patient that exists changes nothing and is not logged. Events without a patient are left out.
        """
        keys = ["timestamp", *(order or [])]
        rows = events.where(F.col("patient_id").isNotNull()).select(F.col("patient_id").cast("string"), "event_type", F.coalesce("payload", F.create_map().cast("map<string,string>")).alias("payload"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)])
        known = self.states().select("patient_id", F.col("version").alias("_held"))
        w = Window.partitionBy("patient_id").orderBy(*[f"_o{i}" for i in range(len(keys))])
        rows = rows.withColumn("_n", F.row_number().over(w)).join(known, "patient_id", "left")
        new = F.col("_held").isNull()
        rows = rows.where((F.col("event_type") != "create") | (new & (F.col("_n") == 1)))
        first = F.struct(F.lit("create").alias("event_type"), F.create_map().cast("map<string,string>").alias("payload"), F.lit(0).alias("part"))
        own = F.struct("event_type", "payload", F.lit(1).alias("part"))
        both = F.when(new & (F.col("_n") == 1) & (F.col("event_type") != "create"), F.array(first, own)).otherwise(F.array(own))
        rows = rows.select("patient_id", "_held", "_n", F.col("_o0").cast("timestamp").alias("timestamp"), F.explode(both).alias("e")).select("*", "e.*")
        count = F.row_number().over(Window.partitionBy("patient_id").orderBy("_n", "part"))
        rows = rows.withColumn("version", F.coalesce("_held", F.lit(0)) + count)
        return self._write("log", rows.select("patient_id", F.col("version").cast("long"), "event_type", "payload", "timestamp"))

    def create(self, states: DataFrame) -> int:
        """Create patients from ``patient_id, payload, timestamp``; those that exist stay as they are."""
        return self.append(states.withColumn("event_type", F.lit("create")))

    def update(self, updates: DataFrame) -> int:
        """Merge payloads into states; keys that a state does not have are logged and change nothing."""
        return self.append(updates.withColumn("event_type", F.lit("update")))

    def intervene(self, interventions: DataFrame) -> int:
        """Log ``patient_id, intervention_type, summary, details, timestamp``; details are a map of strings."""
        payload = F.create_map(F.lit("intervention_type"), F.col("intervention_type"), F.lit("summary"), F.col("summary"), F.lit("details"), F.to_json(F.coalesce("details", F.create_map().cast("map<string,string>"))))
        return self.append(interventions.select("patient_id", F.lit("intervention").alias("event_type"), payload.alias("payload"), "timestamp"))

    def snapshot(self) -> int:
        """Write the present states; later reads start from them."""
        return self._write("snapshots", self.states())

    def _write(self, kind: str, rows: DataFrame) -> int:
        newest = self.commits.newest()
        snapshot = self.commits.read(newest)["snapshot"] if newest else 0
        number, target = newest + 1, f"{self.path}/{kind}/{newest + 1}"
        if exists(self.spark, target):  # left by a write that failed before its commit
            delete(self.spark, target)
        rows.write.parquet(target)
        self.commits.add(number, {"snapshot": number if kind == "snapshots" else snapshot})
        return number
