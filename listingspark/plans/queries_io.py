"""Queries that go through files and streams, and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import alerts as A
from listingspark.operators import enrich as E
from listingspark.operators import score as C
from listingspark.operators import tables
from listingspark.plans.streams import drained, shared_folder
from listingspark.plans import sqltext as S
from listingspark.registry import query
from listingspark.sources import messages as M
from listingspark.streaming import alerts as stream
from listingspark.streaming.ingest import append_stream, ingest_stream, latest_rows, processed_messages

MV = ["messages_v"]


def _landed(v, files: int = 4) -> str:
    folder = shared_folder(v.spark)
    rows = v("messages_v").select("message_id", "sender", "subject", F.col("ts").cast("timestamp").alias("ts"), F.nullif("html", F.lit("")).alias("html"), "text")
    rows.repartition(files).write.parquet(f"{folder}/in")
    return folder


@query("a01_read_messages", MV, "select message_id, sender, html, text from messages_v")
def _(v):
    return M.read_messages(v.spark, f"{_landed(v)}/in").select("message_id", "sender", "html", "text")


@query("a02_stream_messages", MV, "select message_id, sender from messages_v")
def _(v):
    """Every landed message once, through a deduplicating stream over the files."""
    folder = _landed(v)
    rows = stream.deduplicated(M.stream_messages(v.spark, f"{folder}/in"), 36500)
    return drained(rows.select("message_id", "sender"), folder)


@query("a12_ingest_stream", MV, "select message_id, sender, cast(ts as date) as day, cast(1 as bigint) as n_listings from messages_v")
def _(v):
    """Every landed message once, though half of them land again and the second run starts anew."""
    folder = _landed(v)
    again = v.spark.read.parquet(f"{folder}/in").filter(F.pmod(F.xxhash64("message_id"), F.lit(2)) == 0)
    again.write.mode("append").parquet(f"{folder}/in")
    for run in ("first", "second"):
        extract = lambda rows: rows.select("message_id", F.length("text").alias("size"))
        ingest_stream(M.stream_messages(v.spark, f"{folder}/in", files_per_trigger=3), f"{folder}/tables", f"{folder}/{run}", extract).awaitTermination()
    return processed_messages(v.spark, f"{folder}/tables").select("message_id", "sender", "day", "n_listings")


@query("a05_export_csv", ["listings_v", "export_v"], "select address, town, price, cast(home_id as varchar) as home_id from export_v")
def _(v):
    folder = shared_folder(v.spark)
    e = v("export_v")
    url = F.concat(F.lit("https://www.redfin.com/home/"), F.col("home_id").cast("string"))
    e.select(F.col("address").alias("ADDRESS"), F.col("town").alias("CITY"), F.concat(F.col("price").cast("string"), F.lit(".0")).alias("PRICE"), url.alias("URL (see the site for more)")).write.csv(f"{folder}/export", header=True)
    return M.read_listing_export_csv(v.spark, f"{folder}/export").select("address", "town", "price", "home_id")


@query(
    "a04_flatten_mime_tree",
    MV,
    "select message_id, case when listing_id % 3 = 0 then concat('last ', cast(listing_id as varchar)) else concat('<p>', cast(listing_id as varchar), '</p>') end as html, case when listing_id % 5 = 4 then '' when listing_id % 2 = 0 then concat('deep é ', cast(listing_id as varchar)) else concat('first ', cast(listing_id as varchar)) end as text from messages_v",
)
def _(v):
    """Part trees of three levels, the chosen parts at different depths."""
    k = F.col("listing_id")
    said = lambda ahead, behind="": F.translate(F.base64(F.encode(F.concat(F.lit(ahead), k.cast("string"), F.lit(behind)), "utf-8")), "+/", "-_")
    leaf = lambda mime, data: F.concat(F.lit(f'{{"mimeType": "{mime}", "body": {{"data": "'), data, F.lit('"}}'))
    many = lambda mime, *parts: F.concat(F.lit(f'{{"mimeType": "multipart/{mime}", "parts": ['), F.concat_ws(", ", *parts), F.lit("]}"))
    none = F.lit(None).cast("string")
    related = many("related", leaf("text/html", said("<p>", "</p>")), F.when((k % 2 == 0) & (k % 5 != 4), leaf("text/plain", said("deep é "))).otherwise(none))
    first = F.when(k % 5 != 4, leaf("text/plain", said("first "))).otherwise(none)
    tree = many("mixed", first, many("alternative", related, leaf("text/html", F.lit(""))), F.when(k % 3 == 0, leaf("text/html", said("last "))).otherwise(none))
    return M.flatten_mime_tree(v("messages_v").select("message_id", tree.alias("payload"))).select("message_id", "html", "text")


@query("a07_read_price_index_csv", ["price_index_v"], "select zip, m3 as value from price_index_v where m3 is not null")
def _(v):
    folder = shared_folder(v.spark)
    x = v("price_index_v")
    x.select(F.col("zip").alias("RegionName"), F.col("region_type").alias("RegionType"), F.col("m1").alias("2025-11-30"), F.col("m2").alias("2025-12-31"), F.col("m3").alias("2026-01-31")).write.csv(f"{folder}/index", header=True)
    return M.read_price_index(v.spark, f"{folder}/index")


@query("a11_upsert_table", ["scores_v"], "select listing_id, case when listing_id % 3 = 0 then 1000 else score end as score from scores_v where listing_id % 2 = 0 or listing_id % 3 = 0")
def _(v):
    """A stream of score rows as an appended table, of which the last row of each listing counts."""
    folder = shared_folder(v.spark)
    s = v("scores_v").select("listing_id", "score")
    s.filter("listing_id % 2 = 0").withColumn("at", F.lit(1)).write.parquet(f"{folder}/in")
    s.filter("listing_id % 3 = 0").select("listing_id", F.lit(1000).cast("long").alias("score"), F.lit(2).alias("at")).write.mode("append").parquet(f"{folder}/in")
    rows = v.spark.readStream.schema("listing_id long, score long, at int").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    append_stream(rows, f"{folder}/scores", f"{folder}/state").awaitTermination()
    return latest_rows(v.spark, f"{folder}/scores", ["listing_id"], ["at"]).drop("at")


@query("e08_best_elementary", ["schools_v"], "select zip, max(percentile) as best from schools_v where contains(lower(level), 'elem') group by 1")
def _(v):
    rows = v("schools_v").filter(F.lower("level").contains("elem"))
    by_zip = rows.groupBy("zip").agg(F.collect_list(F.struct("percentile")).alias("schools"))
    return by_zip.select("zip", E.best_elementary(F.col("schools")).alias("best"))


@query("f06_strip_json_fence", ["scores_v"], "select listing_id, coalesce(soft_points_json, '') as body from scores_v")
def _(v):
    fenced = F.concat(F.lit("```json\n"), F.coalesce("soft_points_json", F.lit("")), F.lit("\n```"))
    return v("scores_v").select("listing_id", T.strip_json_fence(fenced).alias("body"))


@query(
    "f16_criteria_thresholds",
    ["criteria_v"],
    "select version, " + ", ".join(f"try_cast(nullif(replace({x}, ',', ''), '') as bigint) as {n}" for n, x in S.thresholds().items()) + " from criteria_v",
)
def _(v):
    return C.criteria_thresholds(v("criteria_v"))


@query(
    "h11_two_strike_prune",
    ["listings_v"],
    """select listing_id, case listing_id % 3 when 0 then case when listing_status = 'Sold' then case when toured or liked or tour_requested then 'protect' else 'delete' end else 'mark_sold' end when 1 then 'mark_pending' else 'mark_absent' end as action from listings_v""",
)
def _(v):
    rows = v("listings_v").withColumn("listing_status", F.when(F.col("listing_status") == "Sold", "Sold?").otherwise(F.col("listing_status")))
    names = F.element_at(F.array(*map(F.lit, ["sold", "pending", "absent"])), (F.col("listing_id") % 3 + 1).cast("int"))
    return A.two_strike_prune(rows, rows.select("listing_id", names.alias("detected")))


@query("j03_backfill_fingerprints", ["listings_v", "scores_v"], "select listing_id, input_fingerprint is not null or (scored_at is not null and not coalesce(enriched_at > scored_at, false)) as stamped from scores_v")
def _(v):
    out = tables.backfill_fingerprints(v("listings_v"), v("scores_v"), ["address", "town", "price"])
    return out.select("listing_id", F.col("input_fingerprint").isNotNull().alias("stamped"))


@query("l_late_messages", MV, "select cast(ts as date) as day, count(*) as n from messages_v where ts < date '1995-12-11' group by 1")
def _(v):
    return stream.late_messages(v("messages_v"), F.lit("1996-01-01").cast("date"))


@query("h07_alert_volume_stream", ["alerts_v"])
def _(v):
    """Closed seven-day windows of the alert stream, drained from files."""
    folder = shared_folder(v.spark)
    alerts = v("alerts_v").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    alerts.repartitionByRange(4, "sent_at").write.parquet(f"{folder}/in")
    return drained(stream.alert_volume_stream(v.spark.readStream.schema(alerts.schema).parquet(f"{folder}/in")), folder)
