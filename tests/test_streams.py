"""Streams that stop and start again, late events, repeats and crashes, against batch results."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingspark.operators import alerts
from listingspark.streaming.ingest import append_stream, ingest_batch, ingest_stream, ingested, latest_rows, processed_messages
from listingspark.config import DEFAULT
from listingspark.streaming.ordered import Health, alert_latch_late_stream, ingest_health_stream
from tests.test_stateful import SCHEMA, latch_machine, random_events

MESSAGES = "message_id string, sender string, subject string, ts timestamp, text string"


def mails(ids, day=1):
    return [(f"m{i}", "a@x.com", f"s{i}", datetime(2026, 1, day) + timedelta(hours=i), "x" * (i % 3)) for i in ids]


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def extract(rows):
    """As many listings as a text has letters."""
    return rows.select("message_id", F.explode(F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text")))).alias("position"))


def counts(spark, path):
    done = {r.message_id: r.n_listings for r in processed_messages(spark, path).collect()}
    assert processed_messages(spark, path).count() == len(done)
    return done


def test_ingest_takes_each_message_once_across_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda state: ingest_stream(stream(), out, str(tmp_path / state), extract).awaitTermination()
    land(spark, src, mails(range(10)) + mails(range(5)) + [(None, "a", "b", None, "x")], MESSAGES)
    run("c")
    land(spark, src, mails(range(5, 40)), MESSAGES)
    land(spark, src, mails([3, 41]) + [("m50", "a@x.com", "late", None, "xx"), ("m50", "a@x.com", "late", None, "xx")], MESSAGES)
    run("c")
    want = {f"m{i}": i % 3 for i in [*range(40), 41]} | {"m50": 2}
    assert counts(spark, out) == want
    # a new checkpoint reads all files again; nothing is taken twice
    run("another")
    assert counts(spark, out) == want
    assert ingested(spark, out).count() == sum(want.values())
    assert ingested(spark, out, "messages").count() == len(want)


def test_a_batch_that_failed_runs_again_as_the_same(spark, tmp_path):
    out = str(tmp_path / "out")
    first, second = spark.createDataFrame(mails(range(6)), MESSAGES), spark.createDataFrame(mails(range(4, 12)), MESSAGES)

    def breaks(rows):
        return extract(rows).withColumn("position", F.when(F.col("message_id") == "m11", F.raise_error(F.lit("lost"))).otherwise(F.col("position")))

    ingest_batch(first, out, "r", 0, extract)
    with pytest.raises(Exception, match="lost"):
        ingest_batch(second, out, "r", 1, breaks)
    assert sorted(counts(spark, out)) == sorted(f"m{i}" for i in range(6))
    # what the broken batch has written is not seen, and its second try finds what it found
    assert {r.message_id for r in ingested(spark, out, "messages").collect()} == {f"m{i}" for i in range(6)}
    for _ in range(2):
        ingest_batch(second, out, "r", 1, extract)
        assert counts(spark, out) == {f"m{i}": i % 3 for i in range(12)}
    assert ingested(spark, out).count() == sum(i % 3 for i in range(12))


def test_appended_table_keeps_the_last_row_of_a_key(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)], [(3, "old", 1)]):
        land(spark, src, rows, "k long, v string, at int")
        append_stream(spark.readStream.schema("k long, v string, at int").parquet(src), out, state).awaitTermination()
    assert sorted(map(tuple, latest_rows(spark, out, ["k"], ["at"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def drain(spark, stream, tmp_path):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_late_latch_equals_machine_across_a_restart(spark, tmp_path):
    rows = random_events(700, 3)
    rng = random.Random(1)
    arriving = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 55)))
    stream = lambda: alert_latch_late_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 hour")
    for k in range(2):
        land(spark, str(tmp_path / "in"), arriving[k * 200 : k * 200 + 200], SCHEMA)
    half = drain(spark, stream(), tmp_path).count()
    end = (-1, datetime(2027, 1, 1), 0, None, None, None)
    # the last file has an event from before the watermark: it is too late and changes nothing
    land(spark, str(tmp_path / "in"), arriving[400:], SCHEMA)
    land(spark, str(tmp_path / "in"), [end], SCHEMA)
    land(spark, str(tmp_path / "in"), [(0, datetime(2026, 1, 1), 9999, 90, True, False), (None, datetime(2026, 1, 1), 1, 90, True, False)], SCHEMA)
    got = drain(spark, stream(), tmp_path)
    assert 0 < half < got.count()
    assert sorted((r.listing_id, r.event_id, r.score, r.reason) for r in got.collect()) == latch_machine(rows)
    conf = json.loads((tmp_path / "c" / "offsets" / "0").read_text().split("\n")[1])["conf"]
    assert "RocksDB" in conf["spark.sql.streaming.stateStore.providerClass"]


POLLS = "source string, ts timestamp, event_id long, ok boolean, n_new long, error string"


def test_health_stream_equals_batch_after_every_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        ok = rng.random() < 0.7
        rows.append((rng.choice("ab"), datetime(2026, 1, 1) + timedelta(hours=7 * i), i, ok, rng.choice([0, 0, 0, 2]) if ok else 0, None if ok else rng.choice(["HTTP 401", "timeout"])))
    rows.append(("c", datetime(2026, 1, 2), 500, True, 0, None))
    polls = spark.createDataFrame(rows, POLLS)
    arriving = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 20)))
    stream = lambda: ingest_health_stream(spark.readStream.schema(POLLS).parquet(str(tmp_path / "in")), "1 day")
    for part in (arriving[:25], arriving[25:], [("~", datetime(2027, 1, 1), 999, True, 0, None)]):
        land(spark, str(tmp_path / "in"), part, POLLS)
        got = drain(spark, stream(), tmp_path)
    told = got.filter("source <> '~'").collect()
    assert {r.source for r in told if r.timer} == {"a", "b", "c"}
    for r in told:
        (want,) = alerts.ingest_health(polls.filter((F.col("source") == r.source) & (F.col("ts") <= F.lit(r.ts))), F.lit(r.ts)).collect()
        assert (r.auth_error, r.last_success, r.stale, r.empty_run) == (want.auth_error, want.last_success, want.stale, want.empty_run)
    assert len([r for r in told if not r.timer]) >= 4


class Kept:
    """State of one key in memory; a value or a list."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if isinstance(self.rows, tuple) else iter(self.rows)

    def update(self, row):
        self.rows = (row,)

    def put(self, rows):
        assert rows
        self.rows = list(rows)

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows.extend(rows)

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState
    registerTimer = lambda self, ms: self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_health_holds_polls_by_batch_and_tells_what_a_loop_does():
    rng = random.Random(7)
    polls = [(3_600_000_000 * rng.randrange(400) + rng.randrange(3), i, rng.random() < 0.8, rng.choice([None, 0, 0, 0, 0, 3]), rng.choice([None, "HTTP 401", "timeout"])) for i in range(1200)]
    handle, past, told = Handle(), -1, []
    arriving = sorted(polls, key=lambda p: p[0] + 3_600_000_000 * rng.uniform(0, 60))
    for k in range(0, 1200, 100):
        health = Health(DEFAULT)
        health.init(handle)
        part = [p for p in arriving[k : k + 100] if p[0] > past * 1000]
        batches = [pd.DataFrame(part[i : i + 40], columns=["us", "event_id", "ok", "n_new", "error"]) for i in range(0, len(part), 40)]
        list(health.handleInputRows(("a",), iter(batches), Clock(past)))
        assert sum(len(x.rows) for x in handle.states.values()) <= 3 * (k // 100 + 1) + 1
        past = max(p[0] for p in arriving[: k + 100]) // 1000 - 60 * 3_600_000 if k < 1100 else 10**12
        rows = [r for f in health.handleExpiredTimer(("a",), Clock(past), None) for r in f.itertuples(index=False)]
        told += [r for r in rows if not r.timer]
    assert len(told) > 5 and {bool(r.auth_error) for r in told} == {True, False}
    for r in told:
        run, last, error = 0, None, None
        for us, _, ok, new, error in sorted((p for p in polls if p[0] <= r.us), key=lambda p: p[:2]):  # noqa: B007
            run, last = run + 1 if ok and not new else 0, us if ok else last
        assert (r.empty_run, r.last_us, bool(r.auth_error), bool(r.stale)) == (run, last, error == "HTTP 401", last < r.us - DEFAULT.stale_hours * 3_600_000_000)
