"""Queries of message selection, record extraction and landed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import extract as X
from listingspark.operators import resolve
from listingspark.plans import sqltext as S
from listingspark.registry import query
from listingspark.sources import messages as M

MV = ["messages_v"]


@query("a03_select_messages", MV, "select message_id from messages_v where ((contains(lower(sender), 'onehome') or contains(lower(sender), 'realty')) and ts >= date '1997-12-11' or contains(lower(sender), 'redfin') and ts >= date '1996-01-01') and listing_id % 7 <> 0")
def _(v):
    done = v("messages_v").filter("listing_id % 7 = 0")
    out = M.select_messages(v("messages_v"), ["onehome", "realty"], F.lit("1998-01-01").cast("date"), 21, {"redfin": 731}, done)
    return out.select("message_id")


@query("a04_flatten_mime", MV, "select message_id, text, html from messages_v")
def _(v):
    b64 = lambda c: F.translate(F.base64(F.encode(F.col(c), "utf-8")), "+/\r\n", "-_")
    part = lambda m, d: F.struct(F.lit(m).alias("mime"), d.alias("data"))
    rows = v("messages_v").withColumn("parts", F.array(part("text/plain", F.lit("eA==")), part("text/plain", b64("text")), part("text/html", b64("html")), part("text/html", F.lit(""))))
    return M.flatten_mime(rows.drop("text", "html")).select("message_id", "text", "html")


URLS = "u as (select listing_id as page_id, split_part(replace(listing_url, 'http://', 'https://'), '?', 1) as url from listings_v where listing_url is not null)"


def _pages(v):
    url = F.substring_index(F.regexp_replace("listing_url", "^http://", "https://"), "?", 1)
    return v("listings_v").filter("listing_url is not null").select((F.col("listing_id") % 500).alias("page_id"), F.concat(F.lit("<a href='"), url, F.lit("'>x</a>")).alias("body"))


@query("a08_search_result_urls", ["listings_v"], f", {URLS} select url, min(page_id % 500) as first_page from u group by 1")
def _(v):
    return M.search_result_urls(_pages(v))


@query("a09_urls_to_listings", ["listings_v"], rf", {URLS} select url, 'NY' as state, 'Town' as town, concat(regexp_extract(url, 'Town/(\d+)-', 1), ' Main St') as address, nullif(regexp_extract(url, '/home/(\d+)', 1), '') as home_id from u")
def _(v):
    urls = _pages(v).select(T.extract(F.col("body"), M.RESULT_URL, 0).alias("url"))
    return M.urls_to_listings(urls).drop("zip_code")


@query("a10_sync_search", ["listings_v"], rf", {URLS}, n as (select distinct regexp_extract(url, '/home/(\d+)', 1) as h, url from u), old as (select distinct {S.home_id()} as h from listings_v where listing_id % 3 = 0 and listing_url is not null) select count(*) as found, count(*) filter (h not in (select h from old)) as added, count(*) filter (h in (select h from old)) as skipped from n")
def _(v):
    urls = M.search_result_urls(_pages(v)).select("url")
    keyed = resolve.with_keys(v("listings_v").filter("listing_id % 3 = 0"))
    return M.sync_search(urls, keyed)[1]


@query("a06_import_export", ["listings_v", "export_v"], f""", old as (select distinct {S.address_key()} as k from listings_v where listing_id % 2 = 0), e as (select *, {S.address_key()} as address_key from export_v where coalesce(address, '') <> '' and coalesce(town, '') <> ''),
    r as (select *, row_number() over (partition by address_key order by listing_id) as rn from e where address_key not in (select k from old where k is not null)) select address_key, listing_id, round(lot_sqft / 43560.0, 2) as lot_acres, coalesce(status, 'Active') as status from r where rn = 1""")
def _(v):
    out = M.import_export(v("export_v"), resolve.with_keys(v("listings_v").filter("listing_id % 2 = 0")), "listing_id")
    return out.select("address_key", "listing_id", "lot_acres", "status")


@query("a12_append_processed", MV, "select message_id from messages_v where listing_id % 3 = 0 or listing_id % 2 = 0")
def _(v):
    m = v("messages_v").select("message_id", "listing_id")
    return M.append_processed(m.filter("listing_id % 2 = 0"), m.filter("listing_id % 3 = 0")).select("message_id")


@query("a13_orphan_messages", MV, "select message_id from messages_v where listing_id % 9 = 0")
def _(v):
    return M.orphan_messages(v("messages_v"), v("listings_v").filter("listing_id % 9 <> 0")).select("message_id")


@query("a14_task_orphans", ["tasks_v"], "select task_id from tasks_v where listing_id % 4 = 0")
def _(v):
    t = v("tasks_v")
    return M.task_orphans(t, t.filter("listing_id % 4 <> 0")).select("task_id")


@query("b01_unwrap_forwarded", MV, r"select message_id, listing_id % 6 in (1, 2) as is_forwarded, case when listing_id % 6 = 1 then regexp_replace(substr(text, strpos(text, '---------- Forwarded message')), '(?s)^.*?\n\s*\n', '') else text end as text from messages_v")
def _(v):
    return X.unwrap_forwarded(v("messages_v")).select("message_id", "is_forwarded", "text")


@query("b02_status_from_subject", MV, "select message_id, case when contains(lower(subject), 'only sold') then 'Sold' when contains(lower(subject), 'only pending') then 'Pending' when contains(lower(subject), 'only active') then 'Active' end as status from messages_v")
def _(v):
    return v("messages_v").select("message_id", T.status_from_subject(F.col("subject")).alias("status"))


@query("b03_split_blocks", MV, r", b as (select message_id, list_filter(string_split_regex(text, '\n\s*\n'), lambda x: regexp_matches(x, '\$\s*([\d,]+(?:\.\d{2})?)') or regexp_matches(x, '(?i)MLS\s*#?\s*(\d+)')) as bs, text from messages_v) select message_id, case when len(bs) > 1 then len(bs) else 1 end as n_blocks from b")
def _(v):
    return X.split_blocks(v("messages_v")).groupBy("message_id").agg(F.count("*").alias("n_blocks"))


@query("b04_is_listing_text", MV, "select message_id, listing_id % 50 <> 7 as is_listing from messages_v")
def _(v):
    return v("messages_v").select("message_id", X.is_listing_text(F.col("text")).alias("is_listing"))


PLAIN = r""", rows as (select message_id, 0 as position, (100 + listing_id % 900) * 1000 as price, 1 + listing_id % 6 as bedrooms, 2437 as sqft, cast(900000 + listing_id % 4000 as varchar) as mls_id, concat(cast(listing_id % 97 + 1 as varchar), ' Oak Street') as address, '10573' as zip_code, listing_id from messages_v where listing_id % 50 <> 7
    union all select message_id, 1, 1250000, 4, null, null, concat(cast(listing_id % 89 + 1 as varchar), ' Elm Road'), '10574', listing_id from messages_v where listing_id % 2 = 0 and listing_id % 50 <> 7)"""


@query("b05_plain_fields", MV, PLAIN + " select message_id, position, price, bedrooms, sqft, mls_id, address, zip_code from rows")
def _(v):
    m = X.unwrap_forwarded(v("messages_v"))
    return X.extract_plain_fields(X.split_blocks(m)).select("message_id", "position", "price", "bedrooms", "sqft", "mls_id", "address", "zip_code")


HTML = """select message_id, 0 as position, (1 + listing_id % 3) * 1000000 + 295000 as price, 'Rye Brook' as town, '10573' as zip_code, cast(900000 + listing_id % 4000 as varchar) as mls_id, 'Active' as listing_status from messages_v where listing_id % 4 = 0
    union all select message_id, 1, 999000, 'Harrison', null, null, null from messages_v where listing_id % 4 = 0"""


@query("b09_html_blocks", MV, HTML)
def _(v):
    return X.extract_html_blocks(v("messages_v")).select("message_id", "position", "price", "town", "zip_code", "mls_id", "listing_status")


@query("b10_backfill_urls", MV, "select message_id, 1 as position, concat('https://x.test/', replace(concat(cast(listing_id % 89 + 1 as varchar), '-elm-road'), ' ', '-'), '/a') as listing_url from messages_v where listing_id % 2 = 0")
def _(v):
    m = v("messages_v").filter("listing_id % 2 = 0")
    street = F.concat((F.col("listing_id") % 89 + 1).cast("string"), F.lit(" Elm Road"))
    rows = m.select("message_id", F.lit(1).alias("position"), street.alias("address")).union(m.select("message_id", F.lit(2), street))
    urls = m.select("message_id", F.lit(0).alias("k"), F.concat(F.lit("https://x.test/"), F.lower(F.translate(street, " ", "-")), F.lit("/a")).alias("url"))
    return X.backfill_urls_from_html(rows, urls)


B11 = PLAIN + """, h as (select listing_id, message_id, 0 as position, (1 + listing_id % 3) * 1000000 + 295000 as price, 4 as bedrooms, 2437 as sqft, cast(900000 + listing_id % 4000 as varchar) as mls_id, concat(cast(listing_id % 97 + 1 as varchar), ' Elm St') as address, 'Rye Brook' as town, '10573' as zip_code, 'Active' as listing_status from messages_v where listing_id % 4 = 0
      union all select listing_id, message_id, 1, 999000, null, null, null, null, 'Harrison', null, null from messages_v where listing_id % 4 = 0),
    p as (select listing_id, message_id, position, price, bedrooms, sqft, mls_id, address, 'Rye' as town, zip_code, null as listing_status from rows where listing_id % 4 <> 0),
    n as (select listing_id, message_id, null, null, null, null, null, null, null, null, null from messages_v where listing_id % 50 = 7 and listing_id % 4 <> 0),
    u as (select *, 'html' as source_format from h union all select *, 'plaintext' from p union all select *, 'none' from n)
    select u.message_id, position, price, bedrooms, sqft, mls_id, address, town, zip_code, source_format, case when source_format <> 'none' then coalesce(listing_status, case when contains(lower(subject), 'only sold') then 'Sold' when contains(lower(subject), 'only pending') then 'Pending' when contains(lower(subject), 'only active') then 'Active' end) end as listing_status
    from u join messages_v m on m.message_id = u.message_id"""


@query("b11_extract_listings", MV, B11)
def _(v):
    return X.extract_listings(v("messages_v")).select("message_id", "position", "price", "bedrooms", "sqft", "mls_id", "address", "town", "zip_code", "source_format", "listing_status")


#: Blocks whose fields lie in other lines than those of ``messages_v``: types, dates, lots, suites, URLs in markup.
DETAILS = """, d as (select listing_id as k, message_id, listing_id % 97 + 1 as n, listing_id % 28 + 1 as day, listing_id % 5 as a, listing_id % 4 as b from messages_v)"""


@query(
    "b11_listing_details",
    MV,
    DETAILS
    + """ select message_id, cast(0 as int) as position, 'plaintext' as source_format, 900000 + k as price, case a when 0 then concat(cast(n as varchar), ' Main Street, Suite 100') when 1 then concat(cast(n as varchar), ' Main Street, Suite B') else concat(cast(n as varchar), ' Main Street') end as address,
      case when a = 3 then 'Rye' else 'White Plains' end as town, case when a = 3 then 'New York' else 'NY' end as state, case when a = 3 then '10580' else '10601' end as zip_code,
      case b when 0 then 'Condo/Co-op' when 1 then 'Single Family Residential' when 2 then 'Multi-Family' end as property_type,
      case when b <> 3 then concat('2025-01-', case when day < 10 then '0' else '' end, cast(day as varchar)) end as list_date, case b when 0 then 0.25 when 1 then round(10890 / 43560.0, 4) end as lot_acres,
      case when a >= 2 and b = 2 then concat('https://www.redfin.com/NY/White-Plains/', cast(n as varchar), '-Main-Street-10601/home/', cast(k as varchar)) end as listing_url from d""",
)
def _(v):
    k = F.col("listing_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n, day, a, b = k % 97 + 1, k % 28 + 1, k % 5, k % 4
    place = F.when(a == 0, text(n, " Main Street, Suite 100| White Plains, NY 10601")).when(a == 1, text(n, " Main Street, Suite B | White Plains, NY 10601"))
    place = place.when(a == 3, text(n, " Main Street\nRye, New York 10580")).otherwise(text(n, " Main Street, White Plains, NY 10601"))
    more = F.when(b == 0, text("Property Type: Condominium\nListed: 01/", day, "/2025\n0.25 acres lot")).when(b == 1, text("Colonial\nDate Listed: January ", day, ", 2025\n10,890 sq ft lot"))
    more = more.when(b == 2, text("Type: Multi-Family\nActive since: Jan ", day, ", 2025")).otherwise("nothing more")
    url = text('<a href="https://www.redfin.com/NY/White-Plains/', n, "-Main-Street-10601/home/", k, '">x</a><a href="https://www.redfin.com/NY/White-Plains/other-10601/home/1">y</a>')
    rows = v("messages_v").select("message_id", "subject", F.when(b == 2, url).otherwise("").alias("html"), text("$", k + 900000, " 4 Beds 2 Baths\n", place, "\n", more).alias("text"))
    return X.extract_listings(rows).select("message_id", "position", "source_format", "price", "address", "town", "state", "zip_code", "property_type", "list_date", "lot_acres", "listing_url")


def _stats_page(v):
    i = F.col("page_id")
    line = F.concat(F.lit("<p>$"), (i % 9 + 1).cast("string"), F.lit("50,000 "), (i % 5 + 1).cast("string"), F.lit(" beds 2.5 baths 1,"), (i % 90 + 10).cast("string"), F.lit("3 sqft Built in "), (i % 90 + 1900).cast("string"), F.lit("</p>"))
    return v.table("pages").withColumn("html", F.concat(F.lit("<script>$9,999,999</script>"), line, F.coalesce("html", F.lit(""))))


@query("b12_page_stats", None, "select page_id, cast(page_id % 9 + 1 as bigint) * 1000000 + 50000 as page_price, page_id % 5 + 1 as page_bedrooms, 1000 + (page_id % 90 + 10) * 10 + 3 as page_sqft, page_id % 90 + 1900 as page_year from pages")
def _(v):
    rows = _stats_page(v).withColumn("html", F.regexp_replace("html", r"\$(\d)50,000", r"\$$1,050,000"))
    return X.extract_page_stats(rows).select("page_id", "page_price", "page_bedrooms", "page_sqft", "page_year")


@query(
    "b12_page_json",
    None,
    """select page_id, case page_id % 4 when 0 then 1950 when 1 then 1960 when 2 then 1931 end as page_year, case page_id % 4 when 0 then '2026-02-15' when 1 then '2026-01-20' end as page_list_date,
      case page_id % 4 when 0 then 0.25 when 1 then 0.25 when 2 then 7.5 else cast(page_id % 9 + 1 as double) end as page_lot_acres from pages""",
)
def _(v):
    """Statistics of scripts ahead of a page: the first that has a field counts, and one that is no JSON is read by pattern."""
    scripts = [
        '<script>{"a": </script><script>{"lotSize": {"@type": "Q", "value": 0.25}, "yearBuilt": 1950, "OnMarketDate": "2026-02-15T00:00:00"}</script><script>{"yearBuilt": 1960, "lotSize": "3 acres"}</script>',
        '<script>{"lotSize": "10,890 sqft", "listDate": "2026-01-20", "YearBuilt": "1960"}</script>',
        '<script>x = {"lotSize": {"value": 7.5}, "yearBuilt": "1931"};</script>',
    ]
    i = F.col("page_id")
    ahead = F.element_at(F.array(*[F.lit(x) for x in scripts], F.lit("<p>1/4 acre</p>")), (i % 4 + 1).cast("int"))
    html = F.concat(ahead, F.lit("<p>"), (i % 9 + 1).cast("string"), F.lit(" acres</p>"), F.coalesce("html", F.lit("")))
    return X.extract_page_stats(v.table("pages").withColumn("html", html)).select("page_id", "page_year", "page_list_date", "page_lot_acres")


@query("b13_reader_fields", None, "select page_id, case when page_id % 7 > 0 then (page_id % 7) * 100000 + 50000 end as reader_price, 2437 as reader_sqft, page_id % 5 + 1 as reader_bedrooms, 1900 + page_id % 100 as reader_year, 12345 as reader_tax from pages")
def _(v):
    i = F.col("page_id")
    body = F.concat(F.lit("FOR SALE\n\n$"), F.when(i % 7 > 0, (i % 7).cast("string")).otherwise(""), F.lit("50,000\n\n2,437\n\nsq ft\n\n"), (i % 5 + 1).cast("string"), F.lit("\n\nbd\n\n2.5 ba\n\n"), (1900 + i % 100).cast("string"), F.lit(" Year Built\nTax Annual Amount: $12,345\n$90/month HOA\n0.25 acres\nLot Size\n"), F.coalesce("html", F.lit("")))
    return X.extract_reader_page_fields(v.table("pages").withColumn("body", body)).select("page_id", "reader_price", "reader_sqft", "reader_bedrooms", "reader_year", "reader_tax")


@query("b14_page_description", None)
def _(v):
    return v.table("pages").select("page_id", X.extract_page_description(F.col("html")).alias("description"))


@query("b15_b16_images", None, "select page_id, case when page_id % 12 + 2 <= 8 then page_id % 12 + 2 else 8 end as n_images from pages")
def _(v):
    n = (F.col("page_id") % 12 + 2).cast("int")
    tags = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('<img width="300" src="https://x.test/a'), i.cast("string"), F.lit('.jpg">'))), "")
    html = F.concat(tags, F.lit('<img src="https://x.test/logo.png"><img width="20" src="https://x.test/s.jpg"><img src="/rel.jpg">'), F.coalesce("html", F.lit("")))
    return v.table("pages").select("page_id", F.size(X.select_images(X.extract_image_urls(html))).cast("long").alias("n_images"))


@query("b17_b18_page_class", None, "select page_id, 'Active' as status, case page_id % 4 when 0 then 'error' when 1 then 'pending' when 2 then 'active' else 'sold' end as class from pages")
def _(v):
    kinds = F.element_at(F.array(*map(F.lit, ["awswaf ", "Under contract ", "This home is for sale ", "Sold on May 1 "])), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.concat(kinds, F.lit('{"MlsStatus": "Active"} '), F.repeat(F.lit("words and so forth "), 20), F.coalesce("html", F.lit("")))
    return v.table("pages").select("page_id", X.page_status(body).alias("status"), X.classify_page(body).alias("class"))


@query("b19_block_page", None, "select page_id, page_id % 3 = 0 as blocked from pages")
def _(v):
    challenge = F.concat(F.lit("<p>Unknown address</p><p>error</p>"), F.left(F.regexp_extract("html", r"(?s)<article>(.*)$", 1), F.lit(400)))
    body = F.when(F.col("page_id") % 3 == 0, challenge).otherwise(F.concat(F.lit("<p>unknown address error</p>"), "html"))
    return v.table("pages").select("page_id", X.is_block_page(body).alias("blocked"))
