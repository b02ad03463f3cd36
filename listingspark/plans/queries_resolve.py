"""Queries of keys, matching, deduplication, folds and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import resolve as R
from listingspark.operators import tables
from listingspark.plans import sqltext as S
from listingspark.registry import query

L = ["listings_v"]
KEYED = f"keyed as (select *, {S.address_key()} as address_key, {S.home_id()} as home_id from listings_v)"


@query("d01_address_key", L, f"select listing_id, {S.address_key()} as address_key, {S.home_id()} as home_id from listings_v")
def _(v):
    return R.with_keys(v("listings_v")).select("listing_id", "address_key", "home_id")


@query("d03_clean_listing_url", L, "select listing_id, case when contains(listing_url, 'redfin.com') then regexp_replace(split_part(listing_url, '?', 1), '^http://', 'https://') else listing_url end as url from listings_v")
def _(v):
    return v("listings_v").select("listing_id", T.clean_listing_url(F.col("listing_url")).alias("url"))


@query(
    "d04_match_existing",
    L,
    f""", {KEYED}, inc as (select listing_id as incoming_id, case when listing_id % 2 = 0 then null else mls_id end as mls_id, case when listing_id % 5 = 0 then null else home_id end as home_id,
      case when listing_id % 3 = 0 then null else address end as address, case when listing_id % 3 = 0 then null else address_key end as address_key from keyed),
    old as (select * from keyed where listing_id % 4 <> 1),
    m as (select mls_id, min(listing_id) as i from old where mls_id is not null group by 1), h as (select home_id, min(listing_id) as i from old where home_id is not null group by 1),
    a as (select address_key, min(listing_id) as i from old where address_key is not null group by 1)
    select incoming_id, case when inc.mls_id is null and inc.address is null then null else coalesce(m.i, h.i, a.i) end as match_id,
      case when inc.mls_id is null and inc.address is null then 'rejected' when m.i is not null then 'mls' when h.i is not null then 'home' when a.i is not null then 'address' else 'new' end as match_tier
    from inc left join m on m.mls_id = inc.mls_id left join h on h.home_id = inc.home_id left join a on a.address_key = inc.address_key""",
)
def _(v):
    keyed = R.with_keys(v("listings_v"))
    i = F.col("listing_id")
    inc = keyed.select(
        i.alias("incoming_id"),
        F.when(i % 2 != 0, F.col("mls_id")).alias("mls_id"),
        F.when(i % 5 != 0, F.col("home_id")).alias("home_id"),
        F.when(i % 3 != 0, F.col("address")).alias("address"),
        F.when(i % 3 != 0, F.col("address_key")).alias("address_key"),
    )
    return R.match_existing(inc, keyed.filter(i % 4 != 1))


ORDER = "coalesce(toured, false)::int desc, (coalesce(mls_id, '') <> '')::int desc, (coalesce(listing_url, '') <> '')::int desc, listing_id"
HOME_ORDER = "(toured or liked or passed or tour_requested)::int desc, (coalesce(description, '') <> '')::int desc, (coalesce(mls_id, '') <> '')::int desc, listing_id"


@query(
    "d05_dedup_by_address_key",
    L,
    f", {KEYED}, r as (select *, row_number() over (partition by address_key order by {ORDER}) as rn from keyed) select listing_id, address_key from r where address_key is null or rn = 1",
)
def _(v):
    return R.dedup_by_address_key(R.with_keys(v("listings_v"))).select("listing_id", "address_key")


@query(
    "d06_dedup_by_home_id",
    L,
    f", {KEYED}, r as (select *, row_number() over (partition by home_id order by {HOME_ORDER}) as rn from keyed) select listing_id, home_id from r where home_id is null or rn = 1",
)
def _(v):
    return R.dedup_by_home_id(R.with_keys(v("listings_v"))).select("listing_id", "home_id")


@query(
    "d07_dedup_report",
    L,
    f", {KEYED}, r as (select *, first_value(listing_id) over (partition by address_key order by {ORDER}) as survivor from keyed where address_key is not null) select address_key, listing_id as loser, survivor from r where listing_id <> survivor",
)
def _(v):
    return R.dedup_report(R.with_keys(v("listings_v")))


SETTLED = "case when lower(trim(new_status)) in ('sold', 'closed') then 'Sold?' else new_status end"


def state(c: str) -> str:
    return f"({S.status_class(c)}) in ('live_market', 'off_market')"



@query(
    "d08_fold_updates",
    ["listings_v", "update_events_v"],
    f""", u as (select *, row_number() over (partition by listing_id order by ts, event_id) as k from update_events_v),
    f as (
      select l.listing_id, cast(0 as bigint) as k, l.price, l.listing_status as status, l.listing_url as url, 0 as price_changes, cast(null as varchar) as direction, false as rescore
      from listings_v l where exists (select 1 from update_events_v e where e.listing_id = l.listing_id)
      union all
      select listing_id, k2, case when fill or change then new_price else price end, case when moves then s2 else status end, case when coalesce(url, '') = '' then new_url else url end,
        price_changes + change::int, case when change and new_price < price then 'down' when change then 'up' else direction end, rescore or fill or change or moves
      from (select *, moves0 and not coalesce(status = s2, false) as moves from (
        select f.*, u.k as k2, u.new_price, u.url as new_url, coalesce(f.price is null and u.new_price >= 100000, false) as fill,
          coalesce(f.price > 0 and u.new_price >= 100000 and f.price <> u.new_price and abs(u.new_price - f.price) <= 0.5 * f.price, false) as change,
          case when lower(trim(u.new_status)) in ('sold', 'closed') then 'Sold?' else u.new_status end as s2,
          coalesce(u.new_status, '') <> '' and not coalesce(lower(trim(f.status)) = lower(trim(u.new_status)), false)
            and not (not ({state('u.new_status')}) and ({state('f.status')})) as moves0
        from f join u on u.listing_id = f.listing_id and u.k = f.k + 1) x) y
    )
    select listing_id, price, status, url, price_changes, direction, rescore from f where k = (select max(u.k) from u where u.listing_id = f.listing_id)""",
)
def _(v):
    return R.fold_updates(v("listings_v"), v("update_events_v"))


@query(
    "d09_fold_status",
    ["update_events_v"],
    f""", x as (select listing_id, last(case when {state('new_status')} then {SETTLED} end ignore nulls) over w as a, last(nullif(new_status, '') ignore nulls) over w as b
    from update_events_v window w as (partition by listing_id order by ts, event_id rows between unbounded preceding and unbounded following)) select distinct listing_id, coalesce(a, b) as status from x""",
)
def _(v):
    return R.fold_status_windowed(v("update_events_v"))


UPD = "upd as (select listing_id, price + 5 as price, concat('d', cast(listing_id as varchar)) as description, listing_status from listings_v where listing_id % 2 = 0)"


@query(
    "d10_coalesce_update",
    L,
    f", {UPD} select l.listing_id, coalesce(l.price, u.price) as price, coalesce(nullif(l.description, ''), u.description, l.description) as description from listings_v l left join upd u using (listing_id)",
)
def _(v):
    t = v("listings_v").select("listing_id", "price", "description")
    u = t.filter("listing_id % 2 = 0").select("listing_id", (F.col("price") + 5).alias("price"), F.concat(F.lit("d"), F.col("listing_id").cast("string")).alias("description"))
    return R.coalesce_update(t, u, "listing_id", ["price", "description"])


@query(
    "d11_partial_enrich_update",
    L,
    f", {UPD} select l.listing_id, case when u.listing_id is not null then u.price else l.price end as price, l.description, case when u.listing_id is not null then timestamp '2026-02-01 00:00:00' end as enriched_at from listings_v l left join upd u using (listing_id)",
)
def _(v):
    t = v("listings_v").select("listing_id", "price", "description")
    u = t.filter("listing_id % 2 = 0").select("listing_id", (F.col("price") + 5).alias("price"), F.lit("x").alias("description"))
    return R.partial_enrich_update(t, u, "listing_id", ["price"], F.expr("timestamp_ntz '2026-02-01 00:00:00'"))


@query(
    "d12_first_non_null_merge",
    L,
    """, a as (select listing_id, case when listing_id % 2 = 0 then 1 end as sqft from listings_v), b as (select listing_id, 2 as sqft, 3 as bedrooms from listings_v where listing_id % 3 = 0)
    select l.listing_id, coalesce(l.sqft, a.sqft, b.sqft) as sqft, coalesce(l.bedrooms, b.bedrooms) as bedrooms, coalesce(l.sqft, a.sqft, b.sqft) is not null and coalesce(l.bedrooms, b.bedrooms) is not null as ok
    from listings_v l left join a using (listing_id) left join b using (listing_id)""",
)
def _(v):
    t = v("listings_v").select("listing_id", "sqft", "bedrooms")
    a = t.select("listing_id", F.when(F.col("listing_id") % 2 == 0, 1).cast("long").alias("sqft"))
    b = t.filter("listing_id % 3 = 0").select("listing_id", F.lit(2).cast("long").alias("sqft"), F.lit(3).cast("long").alias("bedrooms"))
    return R.first_non_null_merge(t, [a, b], "listing_id", ["sqft", "bedrooms"], ["sqft", "bedrooms"]).drop("core_missing")


@query(
    "d13_assign_agent",
    ["messages_v"],
    r""", m as (select message_id, lower(trim(coalesce(nullif(regexp_extract(sender, '<([^>]+)>', 1), ''), sender))) as mail from messages_v)
    select message_id, case when mail = 'bob@homes.test' then 'Bob' when mail like '%@realty.test' then 'Realty' when mail like '%@homes.test' then 'Homes' end as agent from m""",
)
def _(v):
    agents = v.spark.createDataFrame([("bob@homes.test", "Bob"), ("realty.test", "Realty"), ("homes.test", "Homes")], "pattern string, agent string")
    return R.assign_agent(v("messages_v"), agents).select("message_id", "agent")


@query(
    "d14_set_flag",
    None,
    """with e as (select user_id as listing_id, event_type as flag, event_id % 2 = 0 as value, concat('u', cast(event_id % 7 as varchar)) as set_by, ts, event_id from events),
    r as (select *, row_number() over (partition by listing_id, flag order by ts desc, event_id desc) as rn from e) select listing_id, flag, value, case when value then set_by end as set_by from r where rn = 1""",
)
def _(v):
    e = v.table("events").select(F.col("user_id").alias("listing_id"), F.col("event_type").alias("flag"), (F.col("event_id") % 2 == 0).alias("value"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("set_by"), "ts", "event_id")
    return R.set_flag(e)


@query(
    "d15_reconcile",
    ["listings_v", "export_v"],
    f""", {KEYED}, k as (select home_id, min(listing_id) as i from keyed where home_id is not null and listing_id % 5 <> 0 group by 1), l as (select k.home_id, keyed.price from k join keyed on keyed.listing_id = k.i)
    select cast(e.home_id as varchar) as home_id, e.price as new_price, l.price as old_price, case when e.price <> l.price then e.price - l.price end as delta,
      case when l.home_id is null then 'missing' when e.price <> l.price then 'price_drift' else 'in_sync' end as class from export_v e left join l on l.home_id = cast(e.home_id as varchar)""",
)
def _(v):
    return R.reconcile(v("export_v"), R.with_keys(v("listings_v")).filter("listing_id % 5 <> 0"))


@query("d16_delete_by_ids", ["scores_v"], "select listing_id, score from scores_v where listing_id % 10 <> 3")
def _(v):
    s = v("scores_v")
    return R.delete_by_ids(s, s.filter("listing_id % 10 = 3")).select("listing_id", "score")


@query(
    "a11_upsert",
    ["scores_v"],
    "select listing_id, case when listing_id % 3 = 0 then 1000 else score end as score from scores_v where listing_id % 2 = 0 or listing_id % 3 = 0",
)
def _(v):
    s = v("scores_v").select("listing_id", "score")
    return tables.upsert(s.filter("listing_id % 2 = 0"), s.filter("listing_id % 3 = 0").withColumn("score", F.lit(1000).cast("long")), ["listing_id"])


@query("j01_align_schema", ["scores_v"], "select listing_id, score, cast(null as double) as lot_acres from scores_v")
def _(v):
    from pyspark.sql import types as P

    s = v("scores_v").select("listing_id", "score")
    return tables.align_schema(s, P.StructType([P.StructField("score", P.LongType()), P.StructField("lot_acres", P.DoubleType())]))


@query("j02_recompute_keys", L, f", {KEYED} select listing_id, case when listing_id % 2 = 0 then address_key end as old_key, address_key as new_key from keyed where listing_id % 2 <> 0 and address_key is not null")
def _(v):
    keyed = R.with_keys(v("listings_v"))
    return tables.recompute_keys(keyed.withColumn("address_key", F.when(F.col("listing_id") % 2 == 0, F.col("address_key"))))


@query("j04_backfill_notified", L, "select listing_id, true as notified, case when listing_id % 2 = 0 then created_at::timestamp else timestamp '1970-01-01 00:00:00' end as notified_at from listings_v")
def _(v):
    rows = v("listings_v").select("listing_id", F.when(F.col("listing_id") % 2 == 0, F.col("created_at")).cast("timestamp_ntz").alias("notified_at"))
    return tables.backfill_notified(rows)


@query("j05_kv_latest", None, "select event_type as key, arg_max(user_id, event_id) as value from events group by 1")
def _(v):
    e = v.table("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "event_id")
    return tables.kv_latest(e, order=("event_id",))
