"""Folds and the latch against literal state machines, and stream and batch parity."""

import random

from datetime import datetime, timedelta

from listingspark.operators import alerts, resolve
from listingspark.streaming.alerts import alert_latch_stream, deduplicated


def latch_machine(events):
    out, state = [], {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        listing, ts, event, score, live, rescore = e
        s = state.setdefault(listing, {"latched": False, "fired": False, "score": None, "live": None})
        if score is not None:
            s["score"] = score
            if score < 60 and not rescore:
                s["latched"] = False
        if live is not None:
            s["live"] = live
        if not s["latched"] and s["live"] and s["score"] is not None and s["score"] >= 70:
            out.append((listing, event, s["score"], "re_armed" if s["fired"] else "first_time"))
            s["latched"] = s["fired"] = True
    return sorted(out)


def random_events(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        score = rng.randrange(40, 95) if kind < 0.7 else None
        live = rng.random() < 0.7 if kind > 0.5 else None
        rows.append((rng.randrange(8), datetime(2026, 1, 1) + timedelta(minutes=i), i, score, live, rng.random() < 0.2))
    return rows


SCHEMA = "listing_id long, ts timestamp, event_id long, score long, live boolean, criteria_rescore boolean"


def test_latch_equals_state_machine(spark):
    rows = random_events(1500, 3)
    got = alerts.alert_latch(spark.createDataFrame(rows, SCHEMA)).select("listing_id", "event_id", "score", "reason").collect()
    assert sorted(map(tuple, got)) == latch_machine(rows)


def test_latch_stream_equals_batch(spark, tmp_path):
    rows = random_events(400, 5)
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = alert_latch_stream(stream).writeStream.format("memory").queryName("fires").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.sql("select listing_id, event_id, score, reason from fires").collect()
    assert sorted(map(tuple, got)) == latch_machine(rows)


def test_stream_deduplicates(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 2)), ("b", datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "message_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema("message_id string, ts timestamp").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r[0] for r in spark.sql("select message_id from once").collect()) == ["a", "b"]


def fold(price, status, updates):
    state = {"live_market", "off_market"}

    def cls(s):
        s = (s or "").strip().lower()
        if s in ("active", "new listing", "coming soon", "pre on-market", "back on market"):
            return "live_market"
        return "off_market" if s in ("pending", "sold", "closed", "sold?", "off market", "off market?", "contingent", "under contract") else "other"

    for new_price, new_status in updates:
        if new_price is not None and new_price >= 100_000:
            if price is None:
                price = new_price
            elif price > 0 and price != new_price and abs(new_price - price) <= 0.5 * price:
                price = new_price
        if new_status and (status or "").strip().lower() != new_status.strip().lower():
            if not (cls(new_status) not in state and cls(status) in state):
                status = "Sold?" if new_status.lower() in ("sold", "closed") else new_status
    return price, status


def test_fold_equals_loop(spark):
    rng = random.Random(9)
    listings = [(i, rng.choice([None, 0, 500_000, 900_000]), rng.choice([None, "Active", "Price Drop", "Sold?"]), None) for i in range(60)]
    updates = [
        (rng.randrange(60), datetime(2026, 1, 1) + timedelta(minutes=k), k, rng.choice([None, 90_000, 400_000, 800_000, 1_300_000]), rng.choice([None, "", "Open House", "Active", "Sold", "Pending"]), "u")
        for k in range(600)
    ]
    a = spark.createDataFrame(listings, "listing_id long, price long, listing_status string, listing_url string")
    b = spark.createDataFrame(updates, "listing_id long, ts timestamp, event_id long, new_price long, new_status string, url string")
    got = {r.listing_id: (r.price, r.status) for r in resolve.fold_updates(a, b).collect()}
    want = {i: fold(p, s, [(u[3], u[4]) for u in updates if u[0] == i]) for i, p, s, _ in listings if any(u[0] == i for u in updates)}
    assert got == want


def test_dedup_is_idempotent(spark):
    rows = [(i, f"k{i % 5}" if i % 7 else None, i % 3 == 0, "m" if i % 2 else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "listing_id long, address_key string, toured boolean, mls_id string, listing_url string")
    once = resolve.dedup_by_address_key(df)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, resolve.dedup_by_address_key(once).collect()), key=str)
    assert once.filter("address_key is null").count() == df.filter("address_key is null").count()
