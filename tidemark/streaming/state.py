"""The running state of each patient as a stateful stream.

The stream's rows are events: a patient, a time, a sequence number, and for each state key a value and whether the event
writes the key (a written null is a value). A value state for each patient holds each key's value with the event that wrote it last, so that
the state does not depend on the order of arrival: the event of greatest time and number wins, as in the batch fold
(:func:`tidemark.operators.twin.state_history`). Copies of an event count once while they can still arrive, that is until
the watermark passes them; later ones are dropped as late. A patient without an event for ``idle`` of event time expires: a timer
emits its last state and clears it.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.scratch import delete, scratch_dir

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Rows of all slices for each partition of a replayed stream's state, about.
ROWS = 500_000

_START, _MICRO = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), datetime.timedelta(microseconds=1)


class PatientState(StatefulProcessor):
    """Columns in: key, ``at``, ``seq``, ``written`` (a bit for each state key), and a value for each state key."""

    def __init__(self, by: str, keys: list[str], idle_ms: int | None) -> None:
        self.by, self.keys, self.idle_ms = by, keys, idle_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        keys = ", ".join(f"v{i} double, at{i} long, seq{i} long" for i in range(len(self.keys)))
        #: Events so far, the newest one's time, the timer, the events whose copies can still arrive; for each key its writer.
        self.state = handle.getValueState("state", f"n long, at long, timer long, seen_at array<long>, seen_seq array<long>, {keys}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        # of copies the first one counts; the columns are taken by place: key, time, number, keys written (a bit each), values
        batch = sorted(((((r[1] - _START) // _MICRO, r[2]), r) for r in rows), key=lambda x: x[0])
        n, last, timer, *seen = (held := self.state.get() or (0, 0, None, [], [], *[None] * 3 * len(self.keys)))[:5]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        seen = {x for x in zip(*seen, strict=True) if x[0] >= passed}
        now = {k: tuple(held[5 + 3 * i : 8 + 3 * i]) for i, k in enumerate(self.keys)}
        out = []
        for place, row in batch:
            if place in seen:
                continue
            seen.add(place)
            before = [now[k][0] for k in self.keys]
            for i, k in enumerate(self.keys):
                if row[3] >> i & 1 and (now[k][1] is None or place > now[k][1:]):
                    value = row[4 + i]
                    now[k] = (None if value is None or value != value else value, *place)
            n, last = n + 1, max(last, place[0])
            out.append((place[1], place[0], n, False, *(now[k][0] for k in self.keys), *before))
        if not out:
            return
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.idle_ms
            self.handle.registerTimer(timer)
        self.state.update((n, last, timer, [x[0] for x in seen], [x[1] for x in seen], *(x for k in self.keys for x in now[k])))
        yield self._row(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.state.get()
        if held and held[2] == expiredTimerInfo.getExpiryTimeInMs():
            now = [held[5 + 3 * i] for i in range(len(self.keys))]
            self.state.clear()
            yield self._row(key, [(None, held[1], held[0], True, *now, *now)])

    def _row(self, key, out: list[tuple]) -> Row:  # noqa: ANN001
        """The changes of a patient as one row of lists, as each row that a task hands on costs much more than a list's item."""
        names = ("seq", "us", "n_events", "expired", *self.keys, *(f"previous_{k}" for k in self.keys))
        return Row(**{self.by: key[0]}, **{c: list(x) for c, x in zip(names, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def state_changes(events: DataFrame, by: str, at: str, seq: str, keys: dict[str, str], present: dict[str, Column], late: str = "1 day", idle: datetime.timedelta | None = None) -> DataFrame:
    """A row for each event of a stream with the state after it and before it (``<k>, previous_<k>``), ``n_events`` so far.

    ``keys`` maps state keys to value columns, ``present`` says whether an event writes the key. An event that arrives after
    newer ones changes only keys that these did not write. Events later than ``late`` behind the newest are dropped, copies
    (equal time and number) count once, events without a patient or time are left out. With ``idle``, patients expire.
    """
    rows = events.where(F.col(by).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    written = sum((F.when(F.coalesce(present[k], F.lit(False)), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0).cast("long"))
    columns = [F.col(v).cast("double").alias(f"v_{k}") for k, v in keys.items()]
    rows = rows.select(F.col(by), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq"), written.alias("written"), *columns)
    kind = events.schema[by].dataType.simpleString()
    types = {"seq": "long", "us": "long", "n_events": "long", "expired": "boolean"} | {c: "double" for c in (*keys, *(f"previous_{k}" for k in keys))}
    schema = f"`{by}` {kind}, " + ", ".join(f"`{c}` array<{x}>" for c, x in types.items())
    idle_ms = None if idle is None else int(idle.total_seconds() * 1000)
    made = rows.groupBy(by).transformWithState(PatientState(by, list(keys), idle_ms), schema, "Append", "EventTime")
    each = made.select(F.col(f"`{by}`"), F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in types])).alias("_e"))
    return each.select(F.col(f"`{by}`"), *[F.timestamp_micros("_e.us").alias("at") if c == "us" else F.col(f"_e.`{c}`") for c in types])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> None:
    """Run a stream over all that is there now and stop; each micro-batch is a folder ``batch=<n>`` of its own below ``path``.

    A micro-batch that is tried again writes over its folder. ``partitions`` of the state hold from a checkpoint's first run
    on. The session's settings are set back.
    """
    spark = stream.sparkSession
    settings = dict([PROVIDER]) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in settings}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def spans(events: DataFrame, at: str, slices: int) -> Column:
    """Which of ``slices`` equal spans of time a row lies in, from 0; rows without a time are in the first."""
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    ends = [] if lo is None else [lo + (hi - lo) * (i + 1) / slices for i in range(slices - 1)]
    return sum((F.when(F.col(at) > e, 1).otherwise(0) for e in ends), F.lit(0))


def replay(events: DataFrame, arrival: Column, slices: int, job: Callable[[DataFrame], DataFrame], mode: str = "append", partitions: int | None = None) -> DataFrame:
    """What a streaming ``job`` gives for ``events`` that arrive in slices numbered by ``arrival``; ``batch`` is the micro-batch.

    The stream is stopped and started again from its checkpoint for each slice. All files lie in the shared folder. ``partitions``
    are the least there are; large tables have one for each ROWS rows.
    """
    spark = events.sparkSession
    partitions = partitions and max(partitions, math.ceil(events.count() / ROWS))
    base = scratch_dir(spark, "replay")
    stream = None
    for i in range(slices):
        events.where(arrival == i).write.mode("append").parquet(f"{base}/events")
        if stream is None:
            stream = job(spark.readStream.schema(spark.read.parquet(f"{base}/events").schema).parquet(f"{base}/events"))
        run_to_end(stream, f"{base}/out", f"{base}/checkpoint", mode, partitions)
    made = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{base}/out")
    delete(spark, f"{base}/events")
    delete(spark, f"{base}/checkpoint")
    return made


def with_end(events: DataFrame, at: str, after: str = "INTERVAL 30 DAYS") -> DataFrame:
    """``events`` and one row with only a time, ``after`` the newest: once it has passed, all windows and sessions close."""
    end = events.agg((F.max(at) + F.expr(after)).alias(at)).where(F.col(at).isNotNull())
    return events.unionByName(end, allowMissingColumns=True)
