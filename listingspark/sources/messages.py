"""Sources: message tables and streams, exports, indexes and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingspark.functions import text as X
from listingspark.operators.extract import slug_fields

MESSAGES = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("html", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("html", "text")})


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = MESSAGES) -> DataFrame:
    return _whole(spark.read.schema(schema).format(fmt).load(path))


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = MESSAGES, files_per_trigger: int = 5) -> DataFrame:
    return _whole(spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path))


def select_messages(df: DataFrame, senders: list[str], as_of, max_age_days: int = 21, sender_days: dict[str, int] | None = None, processed: DataFrame | None = None) -> DataFrame:
    """Messages of allowed senders within the age limit (0: none), or within a sender's own days."""
    s = F.lower("sender")
    allowed = F.lit(False)
    for x in senders:
        allowed = allowed | s.contains(x.lower())
    if max_age_days:
        allowed = allowed & (F.col("ts") >= F.date_sub(as_of, max_age_days))
    for x, days in (sender_days or {}).items():
        allowed = allowed | (s.contains(x.lower()) & (F.col("ts") >= F.date_sub(as_of, days)))
    out = df.filter(allowed).dropDuplicates(["message_id"])
    return out.join(processed.select("message_id").distinct(), "message_id", "left_anti") if processed is not None else out


def decoded(data: Column) -> Column:
    """Text of base64url data; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.unbase64(F.translate(data, "-_", "+/")).cast("string"))


def flatten_mime(df: DataFrame, parts: str = "parts") -> DataFrame:
    """html and text of a message: its last non-empty part of either type, of a flat array of parts.

    ``parts`` is an array of (mime, data) in base64url; ``flatten_mime_tree`` takes nested ones.
    """

    def last(mime: str):
        found = F.filter(parts, lambda p: (p["mime"] == mime) & (F.length(p["data"]) > 0))
        return F.coalesce(decoded(F.try_element_at(found, F.lit(-1))["data"]), F.lit(""))

    return df.withColumns({"html": last("text/html"), "text": last("text/plain")})


def mime_parts(df: DataFrame, payload: str = "payload", key: str = "message_id") -> DataFrame:
    """(key, path, mime, data): every part of the trees in ``payload``, of whatever depth, path its place in document order.

    ``payload`` is JSON text {mimeType, body: {data}, parts: [...]}; what is no JSON has no
    parts. A recursive query takes one level of all trees after the other; the session's limits on its rows and
    levels are lifted, since trees end by themselves.
    """
    spark = df.sparkSession
    for limit in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"):
        spark.conf.set(limit, "-1")
    roots = df.select(F.col(key).alias("key"), F.try_parse_json(F.col(payload)).alias("part")).filter("part is not null")
    found = spark.sql(
        """with recursive tree(key, path, part) as (
             select key, cast(array() as array<int>), part from {roots}
             union all
             select key, concat(path, array(place)), child from tree lateral view posexplode(try_variant_get(part, '$.parts', 'array<variant>')) p as place, child
           )
           select key, path, try_variant_get(part, '$.mimeType', 'string') as mime, try_variant_get(part, '$.body.data', 'string') as data from tree""",
        roots=roots,
    )
    return found.withColumnRenamed("key", key)


def flatten_mime_tree(df: DataFrame, payload: str = "payload", key: str = "message_id") -> DataFrame:
    """``df`` with html and text: the last non-empty part of either type in document order, at any depth; empty where there is none.

    ``key`` tells rows apart; a row without one, or without parts, has two empty texts.
    """
    parts = mime_parts(df.filter(F.col(key).isNotNull()), payload, key).filter("data <> ''")
    last = lambda mime: F.max_by(F.when(F.col("mime") == mime, F.col("data")), F.when(F.col("mime") == mime, F.col("path")))
    by_row = parts.groupBy(key).agg(last("text/html").alias("__html"), last("text/plain").alias("__text"))
    out = df.drop("html", "text").join(by_row, key, "left")
    given = {n: F.coalesce(decoded(F.col(f"__{n}")), F.lit("")) for n in ("html", "text")}
    return out.withColumns(given).drop("__html", "__text")


def read_listing_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """A saved-search export by header name; rows without an address go."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    url = next((c for c in df.columns if c.startswith("URL (")), "URL")
    pick = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.filter(~X.blank(pick("ADDRESS"))).select(
        pick("ADDRESS").alias("address"),
        pick("CITY").alias("town"),
        pick("STATE OR PROVINCE").alias("state"),
        pick("ZIP OR POSTAL CODE").alias("zip_code"),
        pick("PRICE").try_cast("double").cast("long").alias("price"),
        pick("BEDS").try_cast("double").cast("long").alias("bedrooms"),
        pick("BATHS").try_cast("double").alias("bathrooms"),
        pick("SQUARE FEET").try_cast("double").cast("long").alias("sqft"),
        pick("LOT SIZE").try_cast("double").alias("lot_sqft"),
        pick("YEAR BUILT").try_cast("double").cast("long").alias("year_built"),
        pick("STATUS").alias("status"),
        pick(url).alias("listing_url"),
        X.home_id(pick(url)).alias("home_id"),
    )


def import_export(df: DataFrame, listings: DataFrame, order: str = "row") -> DataFrame:
    """New rows of an export: with address and town, whose key no listing and no earlier row has.

    ``order`` is the row's place in the file; ``listings`` has address_key.
    """
    keyed = df.filter(~X.blank(F.col("address")) & ~X.blank(F.col("town"))).withColumn("address_key", X.address_key(F.col("address"), F.col("town"), F.col("state")))
    fresh = keyed.join(listings.select("address_key").filter("address_key is not null").distinct(), "address_key", "left_anti")
    first = fresh.withColumn("__rn", F.row_number().over(Window.partitionBy("address_key").orderBy(order))).filter("__rn = 1").drop("__rn")
    return first.withColumns({"lot_acres": F.round(F.col("lot_sqft") / 43560.0, 2), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("Active"))})


def read_price_index(spark: SparkSession, path: str) -> DataFrame:
    """(zip, value) of a wide monthly CSV: the last column with a value, by position."""
    df = spark.read.csv(path, header=True)
    months = [c for c in df.columns if c[:4].isdigit()]
    region, kind = ("RegionName", "RegionType")
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{m}`").try_cast("double").alias("v")) for i, m in enumerate(months[-1:])])
    out = df.filter(F.lower(kind) == "zip").select(F.lpad(region, 5, "0").alias("zip"), F.get(table, F.lit(0))["v"].alias("value"))
    return out.filter("value is not null")


RESULT_URL = r"https://www\.redfin\.com/[A-Z]{2}/[^/\s\"']+/[^/\s\"']+/home/\d+"


def search_result_urls(pages: DataFrame, body: str = "body") -> DataFrame:
    """(url, first_page): each listing URL of all pages with the first page that has it."""
    urls = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(RESULT_URL), F.lit(0)))).alias("url"))
    return urls.groupBy("url").agg(F.min("page_id").alias("first_page"))


def page_new_counts(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page_id, n_urls, n_new): URLs of a page, and those that no earlier page has."""
    urls = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(RESULT_URL), F.lit(0)))).alias("url"))
    first = urls.groupBy("url").agg(F.min("page_id").alias("first_page"))
    return urls.join(first, "url").groupBy("page_id").agg(F.count("*").alias("n_urls"), F.count_if(F.col("page_id") == F.col("first_page")).alias("n_new"))


def urls_to_listings(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumns(slug_fields(F.col(url)))


def sync_search(urls: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows with a placeholder score, report): homes and addresses not tracked yet.

    ``listings`` has home_id and address_key.
    """
    found = urls_to_listings(urls).withColumn("address_key", X.address_key(F.col("address"), F.col("town"), F.col("state")))
    by_home = found.join(listings.select("home_id").filter("home_id is not null").distinct(), "home_id", "left_anti")
    by_key = by_home.join(listings.select("address_key").filter("address_key is not null").distinct(), "address_key", "left_anti")
    new = by_key.withColumns({"score": F.lit(0), "verdict": F.lit("Reject"), "concerns": F.array(F.lit("Pending enrichment"))})
    report = found.agg(F.count("*").alias("found")).join(F.broadcast(new.agg(F.count("*").alias("added")))).withColumn("skipped", F.col("found") - F.col("added"))
    return new, report


def append_processed(df: DataFrame, processed: DataFrame) -> DataFrame:
    new = df.dropDuplicates(["message_id"]).join(processed.select("message_id"), "message_id", "left_anti")
    return processed.unionByName(new.select(*processed.columns))


def orphan_messages(messages: DataFrame, listings: DataFrame) -> DataFrame:
    return messages.join(listings.select("listing_id").distinct(), "listing_id", "left_anti")


def task_orphans(tasks: DataFrame, listings: DataFrame) -> DataFrame:
    return tasks.join(listings.select("listing_id").distinct(), "listing_id", "left_anti")
