"""Streams: repeats and late rows, the alert latch over an ordered source, volume windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.config import DEFAULT, Config
from listingspark.session import ship_package

ALERTS = "listing_id long, event_id long, ts timestamp, score long, reason string"
STATE = "latched boolean, fired boolean, score long, live boolean"


def deduplicated(messages: DataFrame, days: int = DEFAULT.max_age_days) -> DataFrame:
    """Messages of a stream without repeats; later ones than the watermark are dropped."""
    return messages.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["message_id"])


def late_messages(messages: DataFrame, as_of, days: int = DEFAULT.max_age_days) -> DataFrame:
    """Counts by day of the rows of a batch that a stream's watermark would drop."""
    return messages.filter(F.col("ts") < F.date_sub(as_of, days)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def latch(cfg: Config = DEFAULT):
    """The latch as a state machine over the time-ordered events of one listing."""
    low = cfg.alert_threshold - cfg.rearm_margin

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latched, fired, score, live = state.get if state.exists else (False, False, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if pd.notna(r.score):
                score = int(r.score)
                if score < low and not r.criteria_rescore:
                    latched = False
            if pd.notna(r.live):
                live = bool(r.live)
            if not latched and live and score is not None and score >= cfg.alert_threshold:
                out.append((key[0], r.event_id, r.ts, score, "re_armed" if fired else "first_time"))
                latched = fired = True
        state.update((latched, fired, score, live))
        yield pd.DataFrame(out, columns=["listing_id", "event_id", "ts", "score", "reason"])

    return run


def alert_latch_stream(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Alerts of a stream of events (listing_id, ts, event_id, score, live, criteria_rescore).

    One row of state for each listing, kept without a time limit and restored from the
    checkpoint, so that a crossing fires once across restarts. A micro-batch holds the
    events of a listing that arrived since the last one; it is their order that counts,
    so the source must deliver a listing's events in order of time.
    """
    ship_package(events.sparkSession)
    return events.groupBy("listing_id").applyInPandasWithState(latch(cfg), ALERTS, STATE, "append", "NoTimeout")


def alert_volume_stream(alerts: DataFrame, size: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    out = alerts.withWatermark("sent_at", delay).groupBy(F.window("sent_at", size, slide).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
