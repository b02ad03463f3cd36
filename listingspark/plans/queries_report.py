"""Queries of views, quality figures and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import report as P
from listingspark.operators import score as C
from listingspark.plans import sqltext as S
from listingspark.registry import query

L = ["listings_v"]
LS = ["listings_v", "scores_v"]
JOINED = ", j as (select l.*, s.verdict, s.confidence, s.evaluation_method from listings_v l left join scores_v s using (listing_id))"


def _joined(v):
    return P.scored_listings(v("listings_v"), v("scores_v"))


@query("i01_scored_listings", LS, JOINED + " select listing_id, verdict, confidence, created_at from j")
def _(v):
    return _joined(v).select("listing_id", "verdict", "confidence", "created_at")


@query("i02_listing_lookup", L, "select listing_id, mls_id from listings_v where mls_id = '900001'")
def _(v):
    return P.listing_lookup(v("listings_v"), "900001").select("listing_id", "mls_id")


OFF = "lower(trim(coalesce(listing_status, ''))) in ('pending', 'sold', 'closed', 'under contract')"


@query("i03_view_active", LS, JOINED + f" select listing_id from j where not passed and not toured and not ({OFF}) and coalesce(verdict not in ('Weak Match', 'Reject'), true)")
def _(v):
    return P.view(_joined(v), "active", True).select("listing_id")


@query(
    "i04_view_counts",
    LS,
    JOINED
    + f""" select count(*) filter (not passed and not toured and not ({OFF})) as active, count(*) as "all", count(*) filter (verdict in ('Strong Match', 'Worth Touring')) as strong, count(*) filter (toured) as toured,
    count(*) filter (liked) as liked, count(*) filter (tour_requested) as want_to_go, count(*) filter (passed) as passed from j""",
)
def _(v):
    return P.view_counts(_joined(v))


@query("i05_sort_by_ppsf", L, "select listing_id, price, sqft from listings_v order by price / sqft nulls last, listing_id limit 100")
def _(v):
    return P.sort_by(v("listings_v"), "ppsf").select("listing_id", "price", "sqft").limit(100)


@query("i06_processing_state", ["scores_v"], f""", {S.PARSED} select listing_id, concerns = ['Pending enrichment'] and evaluation_method <> 'ai_failed' as pending, confidence = 'low' or len(list_filter(hard_results, lambda x: x.passed is null)) >= 2 as uncertain from parsed""")
def _(v):
    return P.processing_state(C.parsed(v("scores_v"))).select("listing_id", "pending", "uncertain")


@query("i07_market_figures", L, "select listing_id, date_diff('day', created_at::date, date '1999-01-01') as days, case when sqft > 0 then round(price / sqft, 1) end as ppsf from listings_v")
def _(v):
    return v("listings_v").select("listing_id", P.days_on_market(F.col("created_at"), F.lit("1999-01-01").cast("date")).cast("long").alias("days"), F.when(F.col("sqft") > 0, F.round(F.col("price") / F.col("sqft"), 1)).alias("ppsf"))


def _filled(c):
    return f"coalesce(cast({c} as varchar) not in ('', '[]', 'null'), false)::int"


@query("i08_quality_pct", L, "select round(sum(" + " + ".join(map(_filled, P.QUALITY_FIELDS)) + f") / (count(*) * {len(P.QUALITY_FIELDS)}) * 100, 2) as quality_pct from listings_v")
def _(v):
    return P.quality_pct(v("listings_v"))


@query("i09_weighted_confidence", L, ", x as (select listing_id, cast(floor(((description is not null)::int * 20 + (commute_minutes is not null)::int * 15 + (year_built is not null)::int * 10) * 100 / 45) as bigint) as data_confidence from listings_v) select *, case when data_confidence >= 80 then 'green' when data_confidence >= 60 then 'yellow' else 'red' end as colour from x")
def _(v):
    out = P.weighted_confidence(v("listings_v"), {c: F.col(c).isNotNull() for c in ("description", "commute_minutes", "year_built")})
    return out.select("listing_id", "data_confidence", "colour")


@query("i10_field_coverage", L, " union all ".join(f"select '{c}' as field, round(avg({_filled(c)}) * 100, 2) as pct from listings_v" for c in P.QUALITY_FIELDS))
def _(v):
    return P.field_coverage(v("listings_v"))


@query("i11_data_quality_report", L, ", x as (" + " union all ".join(f"select 'missing_{c}' as issue, listing_id from listings_v where coalesce({c}, '') = ''" for c in ("address", "listing_url", "town")) + ") select issue, count(*) as n, min(listing_id) as first_id from x group by 1")
def _(v):
    return P.data_quality_report(v("listings_v"))


@query(
    "i11_fix_data_quality",
    ["homes_v"],
    r"""select listing_id, coalesce(nullif(trim(town), ''), case when u <> '' then u end) as town, coalesce(nullif(trim(state), ''), case when u <> '' then 'NY' end) as state from (select *, case when listing_id % 89 = 0 and listing_url is not null then 'Town' else '' end as u0, case when listing_url is not null then 'Town' else '' end as u from homes_v) where listing_id % 83 <> 0""",
)
def _(v):
    rows = v("homes_v").withColumn("address", F.when(F.col("listing_id") % 83 != 0, F.col("address")).otherwise(" "))
    return P.fix_data_quality(rows).select("listing_id", "town", "state")


@query("i11_data_quality_rows", ["homes_v"], " union all ".join(f"select listing_id, 'missing_{c}' as issue from homes_v where coalesce(trim({c}), '') = ''" for c in ("address", "listing_url", "town")))
def _(v):
    return P.data_quality_rows(v("homes_v"))


@query("i05_sort_by_schools", L, "select listing_id, listing_id % 90 as best_school from listings_v order by best_school desc, listing_id limit 100")
def _(v):
    return P.sort_by(v("listings_v").withColumn("best_school", F.col("listing_id") % 90), "schools").select("listing_id", "best_school").limit(100)


UNK = "coalesce(len(list_filter(hard_results, lambda x: x.passed is null)) > 0, false)"


@query("i12_image_audit", LS, f", {S.PARSED}, j as (select l.listing_id, l.listing_id % 3 as n_images, {UNK} as u from listings_v l left join parsed using (listing_id)) select count(*) as total, count(*) filter (n_images > 0) as with_images, count(*) filter (n_images = 0) as without_images, count(*) filter (u) as with_unknowns, count(*) filter (u and n_images = 0) as unknown_without_images from j")
def _(v):
    return P.image_audit(v("listings_v").withColumn("n_images", F.col("listing_id") % 3), C.parsed(v("scores_v")))


@query("i12_unknown_without_images", LS, f", {S.PARSED} select l.listing_id, l.score from listings_v l join parsed using (listing_id) where {UNK} and l.listing_id % 3 = 0 order by l.score desc, l.listing_id limit 20")
def _(v):
    return P.unknown_without_images(v("listings_v").withColumn("n_images", F.col("listing_id") % 3), C.parsed(v("scores_v")))


@query("i13_rescrape_targets", LS, f", {S.PARSED} select l.listing_id from listings_v l join parsed using (listing_id) where {UNK} and l.listing_id % 7 < 3")
def _(v):
    return P.rescrape_targets(v("listings_v").withColumn("n_images", F.col("listing_id") % 7), C.parsed(v("scores_v")))


@query("i14_sender_counts", ["listings_v", "messages_v"], "select sender, count(l.listing_id) as n from messages_v m left join (select listing_id from listings_v where listing_id % 5 <> 3) l using (listing_id) group by 1")
def _(v):
    return P.sender_counts(v("messages_v"), v("listings_v").filter("listing_id % 5 <> 3"))


@query("i15_recent_messages", ["messages_v"], "select message_id, ts from messages_v order by ts desc, message_id desc limit 100")
def _(v):
    return P.recent_messages(v("messages_v"), 100).select("message_id", "ts")


SUBJECT = "case when contains(lower(subject), 'only sold') then 'Sold' when contains(lower(subject), 'only pending') then 'Pending' when contains(lower(subject), 'only active') then 'Active' end"


@query("i16_backfill_status", ["listings_v", "messages_v"], f"select l.listing_id, l.score, subject, {SUBJECT} as new_status from listings_v l join messages_v m using (listing_id) where coalesce(listing_status, '') = ''")
def _(v):
    return P.missing_status_with_subject(v("listings_v"), v("messages_v"))


@query("i17_top_live", L, f"select listing_id, score from listings_v where score > 0 and ({S.status_class('listing_status')}) in ('live_market', 'live_event') order by score desc, listing_id limit 1")
def _(v):
    return P.top_live(v("listings_v")).select("listing_id", "score")


@query("i18_mask_email", ["messages_v"], "select message_id, case when contains(sender, '@') then concat(substr(sender, 1, 1), '***@', split_part(sender, '@', -1)) end as masked from messages_v")
def _(v):
    return v("messages_v").select("message_id", T.mask_email(F.col("sender")).alias("masked"))
