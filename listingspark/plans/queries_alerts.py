"""Queries of alerts, presence, pruning and feed health."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.operators import alerts as A
from listingspark.plans import sqltext as S
from listingspark.registry import query

LIVE = f"({S.status_class('listing_status')}) in ('live_market', 'live_event')"


LATCH = """, e as (select *, row_number() over (partition by listing_id order by ts, event_id) as k from score_events_v),
    f as (select listing_id, cast(0 as bigint) as k, false as latched, false as fired, cast(null as bigint) as event_id, cast(null as bigint) as score, cast(null as varchar) as reason from (select distinct listing_id from e) q
      union all
      select x.listing_id, x.k, case when x.fire then true else x.armed end, x.fired or x.fire, x.event_id, x.score, case when x.fire then case when x.fired then 're_armed' else 'first_time' end end
      from (select e.listing_id, e.k, e.event_id, e.score, f.fired, (f.latched and not (e.score < 60 and not e.criteria_rescore)) as armed,
          not (f.latched and not (e.score < 60 and not e.criteria_rescore)) and e.score >= 70 and e.live as fire
        from f join e on e.listing_id = f.listing_id and e.k = f.k + 1) x)
    select listing_id, event_id, score, reason from f where reason is not null"""


@query("h01_alert_latch", ["score_events_v"], LATCH)
def _(v):
    return A.alert_latch(v("score_events_v")).drop("ts")


@query("h03_claim_alerts", ["listings_v", "scores_v"], f"select l.listing_id, s.score, s.verdict from listings_v l join scores_v s using (listing_id) where listing_id % 2 = 0 and s.score >= 70 and {LIVE}")
def _(v):
    return A.claim_alerts(v("listings_v").withColumn("notified", F.col("listing_id") % 2 != 0), v("scores_v"))


@query("h04_alert_log", ["alerts_v"], "select alert_id, listing_id, coalesce(channel, 'none') as channel, coalesce(channel is not null and delivered, false) as delivered from alerts_v")
def _(v):
    rows = v("alerts_v").withColumn("deliveries", F.when(F.col("channel").isNotNull(), F.create_map("channel", "delivered")))
    return A.alert_log(rows)


@query("h05_recent_alerts", ["alerts_v", "listings_v"], ", t as (select * from alerts_v order by sent_at desc, alert_id desc limit 200) select alert_id, t.listing_id, address from t left join listings_v l on l.listing_id = t.listing_id")
def _(v):
    return A.recent_alerts(v("alerts_v"), v("listings_v"), 200).select("alert_id", "listing_id", "address")


@query("h06_alert_counts", ["alerts_v"], ", b as (select coalesce(reason, 'unknown') as reason, count(*) as n from alerts_v where sent_at >= (select max(sent_at) - interval '7' day from alerts_v) group by 1) select reason, n, cast((select sum(n) from b) as bigint) as total, (select max(sent_at) from alerts_v) as last_alert from b")
def _(v):
    a = v("alerts_v")
    since = a.agg((F.max("sent_at") - F.expr("interval 7 days")).alias("t")).collect()[0]["t"]
    return A.alert_counts_since(a, F.lit(since))


@query("h07_alert_volume", ["alerts_v"], ", d as (select time_bucket(interval '1' day, sent_at) + interval '1' day - (k * interval '1' day) as e0, k from alerts_v, (select unnest(range(0, 7)) as k) q) select e0 - interval '1' day as start, e0 + interval '6' day as \"end\", count(*) as n from d group by 1, 2")
def _(v):
    return A.alert_volume_windows(v("alerts_v")).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("h08_alert_text", ["listings_v"])
def _(v):
    return A.alert_text(v("listings_v"))


@query(
    "h09_weekly_digest",
    ["listings_v", "scores_v"],
    """, w as (select l.listing_id, l.score, s.verdict from listings_v l join scores_v s using (listing_id) where created_at >= date '1996-05-25' and created_at <= date '1996-06-01'), g as (select * from w where verdict in ('Worth Touring', 'Strong Match') order by score desc, listing_id limit 5)
    select (select count(*) from w) as n, (select count(*) from w where verdict in ('Worth Touring', 'Strong Match')) as n_good, (select coalesce(string_agg(cast(listing_id as varchar), ',' order by score desc, listing_id), '') from g) as top, (select round((count(price) + count(sqft) + count(bedrooms)) / (count(*) * 3) * 100, 2) from listings_v) as quality_pct""",
)
def _(v):
    from listingspark.operators.report import quality_pct

    rows = v("listings_v").join(v("scores_v").select("listing_id", "verdict"), "listing_id")
    return A.weekly_digest(rows, F.lit("1996-06-01").cast("date"), quality_pct(v("listings_v"), ("price", "sqft", "bedrooms")))


KEYED = f"keyed as (select *, {S.home_id()} as home_id from listings_v)"


@query(
    "h10_presence_diff",
    ["listings_v"],
    f""", {KEYED}, p as (select distinct home_id from keyed where listing_id % 2 = 0), x as (select listing_id, lower(trim(coalesce(listing_status, ''))) as s, home_id in (select home_id from p where home_id is not null) as here from keyed where home_id is not null)
    select listing_id, case when not here then 'Off Market?' else 'Active' end as new_status from x where (not here and s not in ('sold', 'closed', 'sold?', 'off market?', 'off market')) or (here and s in ('off market?', 'sold?'))""",
)
def _(v):
    from listingspark.operators.resolve import with_keys

    keyed = with_keys(v("listings_v"))
    return A.presence_diff(keyed, keyed.filter("listing_id % 2 = 0"))


DETECT = "case listing_id % 5 when 0 then 'sold' when 1 then 'pending' when 2 then 'absent' when 3 then 'restored' else 'none' end"


@query(
    "h12_prune_report",
    ["listings_v"],
    f""", x as (select *, {DETECT} as d, listing_status = 'Sold' as twice from listings_v)
    select count(*) as checked, count(*) filter (d = 'sold' and not (coalesce(twice, false) and (toured or liked or tour_requested))) as sold, count(*) filter (d = 'pending') as pending, count(*) filter (d = 'absent') as absent, count(*) filter (d = 'restored') as restored,
      count(*) filter (d = 'sold' and twice and (toured or liked or tour_requested)) as protected from x""",
)
def _(v):
    rows = v("listings_v").withColumn("listing_status", F.when(F.col("listing_status") == "Sold", "Sold?").otherwise(F.col("listing_status")))
    names = F.element_at(F.array(*map(F.lit, ["sold", "pending", "absent", "restored", "none"])), (F.col("listing_id") % 5 + 1).cast("int"))
    return A.prune_report(A.two_strike_prune(rows, rows.select("listing_id", names.alias("detected"))))


@query(
    "h13_ingest_health",
    None,
    """with p as (select event_type as source, ts, event_id % 3 <> 0 as ok, case when event_id % 50 = 1 then 1 else 0 end as n_new, case when event_id % 3 = 0 then 'invalid_grant' end as error from events),
    m as (select max(ts) as t from events), f as (select source, max(case when n_new > 0 or not ok then ts end) as full_ts, max(case when ok then ts end) as last_success from p group by 1),
    e as (select source, error from (select *, row_number() over (partition by source order by ts desc) as rn from p) where rn = 1)
    select f.source, coalesce(contains(error, 'invalid_grant'), false) as auth_error, last_success, last_success < (select t from m) - interval '25' hour as stale,
      (select count(*) from p where p.source = f.source and ok and (full_ts is null or p.ts > full_ts)) as empty_run from f join e on e.source = f.source""",
)
def _(v):
    polls = _polls(v)
    now = polls.agg(F.max("ts").alias("t")).collect()[0]["t"]
    return A.ingest_health(polls, F.lit(now))


def _polls(v):
    i = F.col("event_id")
    return v.table("events").select(F.col("event_type").alias("source"), "ts", "event_id", (i % 3 != 0).alias("ok"), F.when(i % 50 == 1, 1).otherwise(0).alias("n_new"), F.when(i % 3 == 0, "invalid_grant").alias("error"))


@query(
    "h13_ingest_health_stream",
    None,
    """with p as (select event_type as source, ts, event_id % 3 <> 0 as ok, case when event_id % 50 = 1 then 1 else 0 end as n_new, case when event_id % 3 = 0 then 'invalid_grant' end as error from events),
    f as (select source, max(ts) as ts, max(case when n_new > 0 or not ok then ts end) as full_ts, max(case when ok then ts end) as last_success from p group by 1),
    e as (select source, error from (select *, row_number() over (partition by source order by ts desc) as rn from p) where rn = 1)
    select f.source, ts, coalesce(contains(error, 'invalid_grant'), false) as auth_error, last_success, last_success < ts - interval '25' hour as stale,
      (select count(*) from p where p.source = f.source and ok and (full_ts is null or p.ts > full_ts)) as empty_run from f join e on e.source = f.source""",
)
def _(v):
    """The last word of the stream on each source, its polls out of order."""
    from listingspark.plans.streams import drained_late
    from listingspark.streaming.ordered import ingest_health_stream

    polls = _polls(v).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = drained_late(polls, "source", "~end", lambda s: ingest_health_stream(s, "30 days")).filter("not timer")
    last = rows.groupBy("source").agg(F.max_by(F.struct("ts", "auth_error", "last_success", "stale", "empty_run"), "ts").alias("x"))
    return last.select("source", "x.*").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "last_success")})


@query("h02_alert_latch_stream", ["score_events_v"])
def _(v):
    """The streaming latch over the events as files, drained at once."""
    from listingspark.plans.streams import latch_over_files

    return latch_over_files(v)


@query("h02_alert_latch_late", ["score_events_v"], LATCH)
def _(v):
    """The latch over events out of order, its state in RocksDB."""
    from listingspark.plans.streams import drained_late
    from listingspark.streaming.ordered import alert_latch_late_stream

    events = v("score_events_v").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained_late(events, "listing_id", -1, lambda s: alert_latch_late_stream(s, "30 days")).drop("ts")


@query(
    "h09_digest_history",
    ["listings_v", "scores_v"],
    """, l as (select l.listing_id, coalesce(s.score, 0) as score, coalesce(s.verdict in ('Worth Touring', 'Strong Match'), false) as good, time_bucket(interval '7' day, cast(created_at as timestamp), timestamp '1970-01-01 00:00:00') as start from listings_v l join scores_v s using (listing_id)),
    r as (select *, row_number() over (partition by start order by score desc, listing_id) as q from l where good)
    select start, start + interval '7' day as "end", count(*) as n, count(*) filter (good) as n_good, coalesce((select string_agg(cast(r.listing_id as varchar), ',' order by q) from r where r.start = l.start and q <= 5), '') as top from l group by start""",
)
def _(v):
    rows = v("listings_v").drop("score").join(v("scores_v").select("listing_id", "score", "verdict"), "listing_id")
    return A.digest_history(rows).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
