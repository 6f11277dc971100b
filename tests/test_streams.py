"""Streams over several batches, with late, repeated and disordered events and restarts, against plain loops."""

import datetime
import random

from sparkloom.plans.streams import QUERIES
from sparkloom.sources.tables import table
from sparkloom.streaming import events as E
from tests.oracle import SF_DIR

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
KINDS = ("view", "click", "purchase", "error", "signup")


def batches(rng, n):
    """n batches of events around rising times: some come up to two hours late, some twice."""
    out, seen = [], []
    for b in range(n):
        rows = []
        for _ in range(40):
            minutes = b * 60 + rng.randrange(0, 60) - (rng.randrange(0, 150) if rng.random() < 0.3 else 0)
            seen.append((len(seen), START + datetime.timedelta(minutes=minutes, seconds=rng.randrange(60), milliseconds=rng.randrange(1, 999)), rng.randrange(4), rng.choice(KINDS), float(rng.randrange(9))))
            rows.append(seen[-1])
        rows += rng.sample(seen, 5) if b else []
        rng.shuffle(rows)
        out.append(rows)
    # A last event of each user long after, so that the watermark passes all others.
    out.append([(9000 + u, START + datetime.timedelta(days=9), u, "other", 0.0) for u in range(4)])
    out.append([(9100 + u, START + datetime.timedelta(days=19), u, "other", 0.0) for u in range(4)])
    return out


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def arrive(spark, path, rows, number):
    """One file of a batch. Files are read in the order of their times."""
    import os
    import pathlib

    part = f"{path}-{number}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
    file = next(pathlib.Path(part).glob("part-*.parquet"))
    pathlib.Path(path).mkdir(exist_ok=True)
    os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    file.rename(f"{path}/{number:03d}.parquet")


def on_time(parts, late):
    """The rows that aren't later than the watermark, which is what the batches before have seen less `late`."""
    newest, out = None, []
    for rows in parts:
        mark = newest - late if newest else None
        out.append([r for r in rows if mark is None or r[1] > mark])
        newest = max([*(r[1] for r in rows), *([newest] if newest else [])])
    return out


def test_states_in_event_time_over_restarts(spark, tmp_path):
    parts = batches(random.Random(5), 5)
    path, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    with E.rocks(spark):
        for first, last in ((0, 2), (2, 3), (3, len(parts))):  # three runs of the same query
            for k in range(first, last):
                arrive(spark, path, parts[k], k)
            got = E.drain(E.ordered_states(stream(spark, path), "30 minutes"), "states", table, checkpoint)
    kept = {r[0]: r for rows in on_time(parts, datetime.timedelta(minutes=30)) for r in rows if r[0] < 9000}
    want, now = [], {}
    for i, _, user, kind, _ in sorted(kept.values(), key=lambda r: (r[1].replace(microsecond=r[1].microsecond // 1000 * 1000), r[0])):
        before = now.get(user, E.FIRST)
        after = E.step(before, kind)
        if after != before:
            want.append((i, user, before, after))
        now[user] = after
    assert sorted((r["event_id"], r["user_id"], r["from_state"], r["to_state"]) for r in got.collect()) == sorted(want) and len(want) > 20
    assert len(kept) < sum(len({r[0] for r in rows}) for rows in parts)  # some were too late or came twice


def test_windows_over_batches_and_restarts(spark, tmp_path):
    parts = batches(random.Random(6), 5)[:-2]
    path, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for first, last in ((0, 3), (3, len(parts))):
        for k in range(first, last):
            arrive(spark, path, parts[k], k)
        got = E.drain_updates(E.windowed(stream(spark, path), "1 hour", late="30 minutes"), ["start", "event_type"], "windows", table, checkpoint)
    want = {}
    # Rows are held against the watermark that closed windows in the batch before, which knows the batches before that; a run ends with an empty batch, so the next run starts with a newer one.
    for rows, known in zip(parts, (0, 0, 1, 3, 3), strict=True):
        mark = max(r[1] for part in parts[:known] for r in part) - datetime.timedelta(minutes=30) if known else None
        for _, at, _, kind, value in rows:
            start = at.replace(minute=0, second=0, microsecond=0)
            if mark is None or start + datetime.timedelta(hours=1) > mark:  # a window is open until the watermark passes its end
                n, total = want.get((start, kind), (0, 0.0))
                want[start, kind] = (n + 1, total + value)
    assert {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in got.collect()} == want
    assert sum(n for n, _ in want.values()) < sum(map(len, parts))


def test_states_of_the_supplied_events(spark):
    want, now = [], {}
    for r in sorted(table(spark, SF_DIR, "events").collect(), key=lambda r: (r["ts"], r["event_id"])):
        before = now.get(r["user_id"], E.FIRST)
        now[r["user_id"]] = E.step(before, r["event_type"])
        if now[r["user_id"]] != before:
            want.append((r["event_id"], r["user_id"], before, now[r["user_id"]]))
    got = QUERIES["stream_states"](spark, SF_DIR).collect()
    assert sorted((r["event_id"], r["user_id"], r["from_state"], r["to_state"]) for r in got) == sorted(want) and len(want) > 100


def test_users_share_the_state_of_few_buckets(spark, tmp_path):
    """Each user had a state, a list and a timer of their own, and calls of the state store for each."""
    rng, late = random.Random(8), datetime.timedelta(days=9)
    rows = [(i, START + datetime.timedelta(seconds=rng.randrange(9000)), rng.choice([None, *range(30)]), rng.choice([*KINDS, "other"]), 0.0) for i in range(900)]
    path, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    with E.rocks(spark):
        for k, part in enumerate([rows[:500], rows[400:], [(9000, START + late, 1, "other", 0.0)]]):
            arrive(spark, path, part, k)
        got = E.drain(E.ordered_states(stream(spark, path), "3 hours", buckets=2), "states", table, checkpoint)
    want, now = [], {}
    for i, _, user, kind, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = now.get(user, E.FIRST)
        now[user] = E.step(before, kind)
        if now[user] != before:
            want.append((i, user, before, now[user]))
    assert {(r["event_id"], r["user_id"], r["from_state"], r["to_state"]) for r in got.collect()} == set(want) and got.count() == len(want) > 100 and any(w[1] is None for w in want)
