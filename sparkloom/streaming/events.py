"""The event log as a stream: windows with watermarks, dense numbering and a task's state machine by key, drained to a table.

`ordered_states` is the state machine in event time: events wait in the state of their user's bucket until the watermark has passed them, so events that come late (but not later than the
watermark), out of order, twice, or in another batch after a restart make no difference; a timer for the earliest one that waits wakes the bucket. Windows are updated batch by
batch (`drain_updates`): each batch's changed rows are a folder of their own, written over if the batch is run again, and the newest row of a key counts; the watermark closes state.

Offsets live in the checkpoint, so a restarted query goes on after the last committed batch and its sinks see each event once. State is
kept by key and partitioned with it; a key's events of one batch are sorted before they are applied.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom.session import scratch

#: What each kind of event does to a task: state before -> state after. Any other event leaves the state as it is.
TRANSITIONS = {
    "view": {"queued": "running", "paused": "running"},
    "click": {"running": "paused"},
    "purchase": {"running": "done", "paused": "done"},
    "error": {"queued": "failed", "running": "failed", "paused": "failed"},
    "signup": {"failed": "queued"},
}
FIRST = "queued"


def read_events(spark: SparkSession, sf_dir: str, files_a_batch: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)
    return stream.parquet(f"{sf_dir}/events.parquet*")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type. Events later than the watermark are dropped by definition."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def numbered(events: DataFrame) -> DataFrame:
    """Each event with its user's next number."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows["sequence_no"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["event_id", "user_id", "event_type", "sequence_no"]]

    schema = "event_id long, user_id long, event_type string, sequence_no long"
    return events.groupBy("user_id").applyInPandasWithState(number, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def ordered(transitions: dict[str, dict[str, str]], first: str) -> StatefulProcessor:
    """A processor for ordered_states. Its class is made here, with all that it needs, so that it travels by value: Spark first starts it on the driver, where the package's archive isn't looked for."""
    import numpy as np

    names = sorted({first} | {x for moves in transitions.values() for move in moves.items() for x in move})
    after = [{names.index(x): names.index(y) for x, y in transitions[kind].items()} for kind in sorted(transitions)]
    start = names.index(first)
    columns = ["event_id", "user_id", "from_state", "to_state"]

    class Ordered(StatefulProcessor):
        """A bucket's events in event time: what the watermark has passed is applied in order, the rest waits. Both kept by frame: a row of state for each event or user costs a call each."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "users binary")
            self.waiting = handle.getListState("waiting", "events binary")

        def wake_at_first(self, waiting: np.ndarray) -> None:
            if len(waiting):
                self.handle.registerTimer(int(waiting[:, 1].min()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            passed, new = timerValues.getCurrentWatermarkInMs(), []
            for part in rows:
                part = part[part["at_ms"] > passed]
                if len(part):
                    new.append(np.column_stack([part[c].astype("int64") for c in ("event_id", "at_ms", "user", "nobody", "kind")]))
            if new:
                self.waiting.appendList([(x.tobytes(),) for x in new])
                self.wake_at_first(np.concatenate(new))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed, out = timerValues.getCurrentWatermarkInMs(), []
            parts = [np.frombuffer(bytes(r[0]), np.int64).reshape(-1, 5) for r in self.waiting.get()]
            if not parts:
                return
            waiting = np.concatenate(parts)
            due, left = waiting[waiting[:, 1] <= passed], waiting[waiting[:, 1] > passed]
            due = due[np.lexsort((due[:, 0], due[:, 2], due[:, 3]))]
            same = (due[1:, [0, 2, 3]] == due[:-1, [0, 2, 3]]).all(axis=1)
            due = due[np.append(~same, True)] if len(due) else due  # an event that came twice counts once
            due = due[np.lexsort((due[:, 0], due[:, 1], due[:, 2], due[:, 3]))]
            known = np.frombuffer(bytes(self.state.get()[0]), np.int64).reshape(-1, 3).tolist() if self.state.exists() else []
            states = {(user, nobody): state for user, nobody, state in known}
            for i, _, user, nobody, kind in due.tolist():
                now = states.setdefault((user, nobody), start)
                then = after[kind].get(now, now) if kind >= 0 else now
                if then != now:
                    out.append((i, None if nobody else user, names[now], names[then]))
                    states[user, nobody] = then
            if len(due):
                self.state.update((np.array([(*who, state) for who, state in states.items()], np.int64).tobytes(),))
                if len(left):
                    self.waiting.put([(left.tobytes(),)])
                else:
                    self.waiting.clear()
            self.wake_at_first(left)
            if out:
                found = dict(zip(columns, map(list, zip(*out, strict=True)), strict=True))
                yield pd.DataFrame(found | {"user_id": pd.array(found["user_id"], "Int64")})

        def close(self) -> None:
            pass

    return Ordered()


def ordered_states(events: DataFrame, late: str = "10 minutes", buckets: int = 512) -> DataFrame:
    """Each change of a user's state in event time, once the watermark has passed it. Events later than the watermark are dropped by definition.
    Users share the state and the timer of their bucket, so calls of the state store grow with buckets and batches, not with users and events; a checkpoint belongs to one number of buckets."""
    kinds = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(i)) for i, kind in enumerate(sorted(TRANSITIONS))], F.lit(-1))
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).select(
        "event_id", "at", F.unix_millis("at").alias("at_ms"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNull().cast("int").alias("nobody"), kinds.alias("kind"),
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"),
    )
    return timed.groupBy("bucket").transformWithStateInPandas(ordered(TRANSITIONS, FIRST), "event_id long, user_id long, from_state string, to_state string", "Append", "EventTime")


def step(state: str, event: str) -> str:
    return TRANSITIONS.get(event, {}).get(state, state)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keys' lists and timers need, for streams started meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def drain(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all that is there, append it to a table and read the table. With given paths a later call goes on from there."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint")
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, keys: list[str], name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The rows of an aggregation after all that is there: the newest of each key over all batches. With given paths a later call goes on from there."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("now"))
    return newest.select(*keys, *[F.col("now")[c].alias(c) for c in rest]).select(stream.columns)
