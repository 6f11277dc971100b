"""Queries that drain the event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.relational import NUMBERED
from sparkloom.plans.relational import SQL as BATCH
from sparkloom.streaming import events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(NUMBERED)
def stream_sequence(spark: SparkSession, d: str) -> DataFrame:
    return events.drain(events.numbered(events.read_events(spark, d)), "sequence")


@query(BATCH["tumbling_window"])
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark closes an hour behind the newest event; each batch's changed windows replace the older ones."""
    return events.drain_updates(events.windowed(events.read_events(spark, d), late="1 hour"), ["start", "event_type"], "windows")


@query()
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """Changes of users' states in event time. The table is one batch that ends the stream, so nothing is later than its newest event."""
    with events.rocks(spark):
        return events.drain(events.ordered_states(events.read_events(spark, d), "0 seconds"), "states")
