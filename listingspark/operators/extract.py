"""Listing records from messages and landed pages: explode jobs of native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.functions import markup as K
from listingspark.functions import text as T
from listingspark.functions.markup import let

# Patterns of the alert layouts.
FORWARD_MARK = "---------- Forwarded message"
PRICE = r"\$\s*([\d,]+(?:\.\d{2})?)"
MLS = r"(?i)MLS\s*#?\s*(\d+)"
BEDS = r"(?i)(\d+)\s*(?:bd|bed|bedroom)s?"
BATHS = r"(?i)(\d+)\s*(?:ba|bath|bathroom)s?"
SQFT = r"(?i)([\d,]+)\s*(?:sq\s*\.?\s*ft|sqft|SF)"
ZIP = r"\b(\d{5})(?:-\d{4})?\b"
STREET_SUFFIX = r"(?:Street|St|Avenue|Ave|Lane|Ln|Drive|Dr|Road|Rd|Court|Ct|Place|Pl|Way|Circle|Cir|Boulevard|Blvd|Terrace|Ter)"
STREET_SIDE = r"(?:\s+(?:N|S|E|W|NE|NW|SE|SW))?"
STREET_LINE = rf"(?im)^\s*(\d+\s+[\w\s.]+{STREET_SUFFIX}\.?{STREET_SIDE})\s*$"
CITY_LINE = r"(?m)^\s*([A-Za-z][\w\s]*?),\s*([A-Za-z][\w\s]*?)\s+(\d{5}(?:-\d{4})?)\s*$"
INLINE = rf"(?i)(\d+[^\n,]+{STREET_SUFFIX}\.?{STREET_SIDE})\s*,\s*([A-Za-z][^\n,]*?)\s*,\s*([A-Z]{{2}})\s+(\d{{5}}(?:-\d{{4}})?)"
SLUG = r"(?i)redfin\.com/([A-Z]{2})/([^/]+)/([^/]+?)(?:-(\d{5}))?/home/(\d+)?"
STATUS_LABELS = (
    "New Listing", "Pending", "Coming Soon", "New Favorite", "Price Drop", "Price Decreased", "Price Increased", "Back on Market",
    "Sold", "Contingent", "Under Contract", "Active", "Open House", "New Tour Insight", "Updated MLS Listing",
)
STATUS_LINE = r"(?im)^\s*(" + "|".join(STATUS_LABELS) + r")\s*$"
TOUR_LINE = r"(?im)^\s*\d+\s+homes?\s+on\s+this\s+tour\s*$"
PAGE_JUNK = (
    "icon", "logo", "avatar", "sprite", "placeholder", "1x1", "pixel", "spacer", "blank", "badge", "flag", "footer", "app-download", "equal-housing",
)
SCORING_JUNK = (
    "badge", "flag", "footer", "app-download", "equal-housing", "1x1", "spacer", "system_files", "150x150", "120x120", "maphomecard", "genmap", "genbcs",
)


def unwrap_forwarded(df: DataFrame) -> DataFrame:
    """Adds is_forwarded; text behind the first marker's headers, html of the quoted part."""
    fwd = F.lower(F.coalesce("subject", F.lit(""))).rlike(r"^\s*(fwd|fw):") | F.col("html").contains("gmail_quote") | F.col("text").contains(FORWARD_MARK)
    after = F.substring(F.col("text"), F.locate(FORWARD_MARK, F.col("text")), F.length("text"))
    body = F.regexp_replace(after, r"(?s)^.*?\n\s*\n", "")
    quoted = T.extract(F.col("html"), r'(?s)<div[^>]*class="[^"]*gmail_quote[^"]*"[^>]*>(.*)</div>')
    return df.withColumns(
        {
            "is_forwarded": F.coalesce(fwd, F.lit(False)),
            "text": F.when(F.col("text").contains(FORWARD_MARK), body).otherwise(F.col("text")),
            "html": F.coalesce(quoted, F.col("html")),
        }
    )


def is_listing_text(c: Column) -> Column:
    n = sum((c.rlike(p).cast("int") for p in (PRICE, MLS, BEDS, BATHS)), F.lit(0))
    return F.coalesce((n >= 2) | c.rlike(T.LIST_URL), F.lit(False))


def blocks_of(text: Column) -> Column:
    """Blocks of a text, by blank lines, else by numbers, else by lines with a URL, else whole."""
    telling = lambda b: b.rlike(PRICE) | b.rlike(MLS)
    by_gap = F.filter(F.split(text, r"\n\s*\n"), telling)
    by_number = F.filter(F.split(text, r"\n\s*\d+[.)]\s+"), telling)
    by_url = F.filter(F.split(text, "\n"), lambda b: b.rlike(T.LIST_URL))
    return F.when(F.size(by_gap) > 1, by_gap).when(F.size(by_number) > 1, by_number).when(F.size(by_url) > 1, by_url).otherwise(F.array(text))


def split_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("*", F.posexplode(blocks_of(F.col(text))).alias("position", "block"))


def title_slug(slug: Column) -> Column:
    return F.initcap(F.trim(F.translate(slug, "-", " ")))


def slug_fields(url: Column) -> dict[str, Column]:
    """state, town, address, zip and home id of a listing URL."""
    slug = T.extract(url, SLUG, 3)
    return {
        "state": T.extract(url, SLUG, 1),
        "town": title_slug(T.extract(url, SLUG, 2)),
        "address": title_slug(slug),
        "zip_code": T.extract(url, SLUG, 4),
        "home_id": T.extract(url, SLUG, 5),
    }


def _untitled(raw: Column) -> Column:
    """A block without its status and tour lines."""
    return F.regexp_replace(F.regexp_replace(raw, STATUS_LINE, ""), TOUR_LINE, "")


def _inline(line: Column, extract=T.extract) -> tuple[Column, Column]:
    """Address and town of a one-line address; what stands before a bar in its town belongs to the address."""
    address, town = F.trim(extract(line, INLINE, 1)), F.trim(extract(line, INLINE, 2))
    suite = F.trim(F.substring_index(town, "|", 1))
    barred = town.contains("|")
    whole = F.when(barred & (suite != ""), F.concat(address, F.lit(", "), suite)).otherwise(address)
    return whole, F.when(barred, F.trim(F.regexp_replace(town, r"^[^|]*\|", ""))).otherwise(town)


def _plain_address(b: Column) -> Column:
    """The address of a block inside a lambda."""
    inline = let(T.extract_once(b, INLINE, 0), lambda line: _inline(line, T.extract_once)[0])
    by_url = let(T.extract_once(b, T.LIST_URL, 0), lambda url: title_slug(T.extract_once(url, SLUG, 3)))
    return F.coalesce(F.trim(T.extract_once(b, STREET_LINE)), inline, by_url)


def _plain_price(b: Column) -> Column:
    return T.number(F.substring_index(T.extract(b, PRICE), ".", 1))


def listing_blocks(text: Column) -> Column:
    """The blocks of a text with a price, an MLS number or an address; the whole text if none has."""
    telling = lambda raw: let(_untitled(raw), lambda b: b.rlike(PRICE) | b.rlike(MLS) | _plain_address(b).isNotNull())
    return let(F.filter(blocks_of(text), telling), lambda found: F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(text), telling)))


# How alerts name a type and a list date.
TYPE_LABEL = r"(?i)(?:style|type|property\s+type|home\s+type)\s*:\s*([\w][\w\s/\-]{1,50})"
TYPE_LINE = (
    r"(?im)^\s*(single[\s\-]family(?:\s+residential)?|single[\s\-]family\s+home|condo(?:minium)?|co[\s\-]?op|townhouse|townhome|"
    r"multi[\s\-]?family|multifamily|two[\s\-]family|mobile[\s\-]home|manufactured[\s\-]home|residential|colonial|ranch|cape\s+cod|"
    r"split[\s\-]level|contemporary|victorian|tudor|farmhouse|craftsman)\s*$"
)
LISTED_SINCE = (
    r"(?i)(?:listed\s*(?:date|on|since)?|date\s+listed|active\s+since|on\s+(?:the\s+)?market\s*(?:since)?)\s*:?\s*"
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[A-Za-z]+\.?\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})"
)


def with_plain_parts(df: DataFrame, block: Column) -> DataFrame:
    """Adds what several fields of a block read: it without status and tour lines, and its matches as such."""
    b = F.col("__b")
    parts = {"__street": F.trim(T.extract(b, STREET_LINE)), "__line": T.extract(b, INLINE, 0), "__city": T.extract(b, CITY_LINE, 0), "__url": F.regexp_replace(T.extract(b, T.LIST_URL, 0), r"[.,;:)]+$", "")}
    return df.withColumn("__b", _untitled(block)).withColumns(parts)


PLAIN_PARTS = ("__b", "__street", "__line", "__city", "__url")


def _plain_fields(raw: Column) -> dict[str, Column]:
    """Fields of a block ``raw`` of rows ``with_plain_parts``.

    A street on a line of its own goes with a town on another; else a one-line address gives
    both, and its URL where there is neither.
    """
    b, street, line, city, url = (F.col(c) for c in PLAIN_PARTS)
    slug = slug_fields(url)
    line_address, line_town = _inline(line)
    inline, by_url = street.isNull() & line.isNotNull(), street.isNull() & line.isNull()
    place = lambda k, own, name: F.when(inline, own).otherwise(F.coalesce(F.trim(T.extract(city, CITY_LINE, k)), F.when(by_url, slug[name])))
    town, address = place(1, line_town, "town"), F.coalesce(street, line_address, slug["address"])
    return {
        "price": _plain_price(b),
        "bedrooms": T.extract(b, BEDS).try_cast("long"),
        "bathrooms": T.extract(b, BATHS).try_cast("double"),
        "sqft": T.number(T.extract(b, SQFT)),
        "mls_id": T.extract(b, MLS),
        "listing_url": url,
        "address": address,
        "town": town,
        "state": place(2, T.extract(line, INLINE, 3), "state"),
        "zip_code": F.coalesce(place(3, T.extract(line, INLINE, 4), "zip_code"), F.when(town.isNull() & address.isNull(), T.extract(b, ZIP))),
        "listing_status": F.initcap(T.extract(raw, STATUS_LINE)),
        "property_type": T.canonical_property_type(F.coalesce(T.extract(b, TYPE_LABEL), T.extract(b, TYPE_LINE))),
        "list_date": T.parse_list_date_text(T.extract(b, LISTED_SINCE)).cast("string"),
    }


def _backfilled(blocks: Column, html: Column) -> Column:
    """The first URL of ``html`` that names the address of each block without a URL; each serves once."""
    urls = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(T.LIST_URL), F.lit(0)), lambda u: F.regexp_replace(F.regexp_extract(u, r"""^[^"'>]*""", 0), r"[.,;:)]+$", "")))
    slug = lambda raw: F.when(~raw.rlike(T.LIST_URL), F.lower(F.translate(F.translate(_plain_address(_untitled(raw)), ".", ""), " ", "-")))
    state = "struct<left:array<string>,out:array<string>>"

    def step(acc: Column, s: Column) -> Column:
        hit = F.get(F.filter(acc["left"], lambda u: F.lower(u).contains(s)), F.lit(0))
        taken = F.when(hit.isNotNull(), F.array_remove(acc["left"], hit)).otherwise(acc["left"])
        return F.struct(taken.alias("left"), F.concat(acc["out"], F.array(hit)).alias("out")).cast(state)

    fold = lambda xs: F.aggregate(F.transform(blocks, slug), F.struct(xs.alias("left"), F.array().alias("out")).cast(state), step, lambda acc: acc["out"])
    return F.when(F.size(urls) > 0, let(urls, fold))


def extract_plain_fields(df: DataFrame, block: str = "block") -> DataFrame:
    """The fields of each block, the first match of each; blocks without price, MLS and address go."""
    rows = with_plain_parts(df, F.col(block))
    out = rows.withColumns(_plain_fields(F.col(block))).drop(*PLAIN_PARTS)
    return out.filter("price is not null or mls_id is not null or address is not null")


HTML_CITY = r"^([^,]+),\s*([A-Za-z ]+?)\s+(\d{5})"
DISPLAY = "div.multiLineDisplay"


def html_parts(html: Column) -> Column:
    """The block markup of a message: each multiLineDisplay element, to where it ends."""
    return K.elements(html, [DISPLAY])


HTML_TEXTS = ("price", "description", "address", "title", "specs")


def html_texts(block: Column) -> Column:
    """The texts of a block's fields, in the order of HTML_TEXTS; of specs all."""
    return K.texts_of(block, [f".highlight-{n}" for n in HTML_TEXTS])


def _html_fields(b: Column, texts: Column) -> dict[str, Column]:
    """Fields of a block ``b`` with its ``html_texts``."""
    field = lambda n: F.nullif(F.get(F.get(texts, F.lit(HTML_TEXTS.index(n))), F.lit(0)), F.lit(""))
    specs = F.array_join(F.get(texts, F.lit(HTML_TEXTS.index("specs"))), " | ")
    return {
        "price": T.number(F.regexp_replace(field("price"), r"[^\d]", "")),
        "bedrooms": T.extract(specs, BEDS).try_cast("long"),
        "bathrooms": T.extract(specs, BATHS).try_cast("double"),
        "sqft": T.number(T.extract(specs, SQFT)),
        "mls_id": T.extract(b, MLS),
        "listing_url": T.extract(b, r'href="([^"]*(?:onehome|redfin|zillow|listing)[^"]*)"'),
        "address": field("description"),
        "town": F.coalesce(F.trim(T.extract(field("address"), HTML_CITY, 1)), field("address")),
        "state": F.trim(T.extract(field("address"), HTML_CITY, 2)),
        "zip_code": T.extract(field("address"), HTML_CITY, 3),
        "listing_status": T.extract(b, r'<img[^>]*alt="([^"]+)"'),
        "property_type": T.canonical_property_type(field("title")),
    }


def extract_html_blocks(df: DataFrame, html: str = "html") -> DataFrame:
    """One row for each multiLineDisplay block, its fields by class."""
    rows = df.select("*", F.posexplode(html_parts(F.col(html))).alias("position", "block")).withColumn("__x", html_texts(F.col("block")))
    return rows.withColumns(_html_fields(F.col("block"), F.col("__x"))).drop("__x")


FIELDS = ("price", "bedrooms", "bathrooms", "sqft", "mls_id", "listing_url", "address", "town", "state", "zip_code", "listing_status", "property_type", "list_date")


def extract_listings(messages: DataFrame) -> DataFrame:
    """(message_id, position, fields, lot_acres, source_format) of all messages in one scan.

    Block markup comes first; where it yields no block, plain text that reads like a listing
    does, and takes missing URLs from the markup. The subject's status fills blank ones; a message
    without any record has one row of format ``none``.
    """
    m = unwrap_forwarded(messages)
    marked = F.coalesce(F.col("html").rlike("highlight-price|multiLineDisplay"), F.lit(False))
    m = m.select("message_id", "subject", "text", "html", F.when(marked, html_parts(F.col("html"))).alias("__parts"))
    m = m.withColumn("__html", F.coalesce(F.size("__parts") > 0, F.lit(False)))
    blocks = F.when(F.col("__html"), F.col("__parts")).when(is_listing_text(F.col("text")), listing_blocks(F.col("text")))
    m = m.withColumn("__blocks", blocks).withColumn("__urls", F.when(~F.col("__html"), _backfilled(F.col("__blocks"), F.col("html"))))
    rows = m.select("message_id", "subject", "__html", "__urls", F.posexplode_outer("__blocks").alias("position", "block"))
    rows = with_plain_parts(rows, F.when(~F.col("__html"), F.col("block"))).withColumn("__x", F.when(F.col("__html"), html_texts(F.col("block"))))
    plain, html = _plain_fields(F.col("block")), _html_fields(F.col("block"), F.col("__x"))
    plain["listing_url"] = F.coalesce(plain["listing_url"], F.get("__urls", F.col("position")))
    html["list_date"] = F.lit(None).cast("string")
    rows = rows.withColumns({n: F.when(F.col("__html"), html[n]).otherwise(plain[n]) for n in FIELDS} | {"lot_acres": T.parse_lot_acres(F.col("block"))})
    found = F.col("position").isNotNull()
    status = F.when(found, F.coalesce(F.nullif("listing_status", F.lit("")), T.status_from_subject(F.col("subject"))))
    source = F.when(~found, "none").when(F.col("__html"), "html").otherwise("plaintext")
    return rows.withColumns({"listing_status": status, "source_format": source}).select("message_id", "position", *FIELDS, "lot_acres", "source_format")


def backfill_urls_from_html(listings: DataFrame, urls: DataFrame) -> DataFrame:
    """(message_id, position, listing_url): each listing's first URL with its address; a URL serves once.

    ``listings``: (message_id, position, address); ``urls``: (message_id, k, url).
    """
    slug = F.lower(F.translate(F.translate(F.col("address"), ".", ""), " ", "-"))
    met = listings.join(urls, "message_id").filter(F.lower("url").contains(slug))
    one = F.row_number().over(Window.partitionBy("message_id", "position").orderBy("k"))
    two = F.row_number().over(Window.partitionBy("message_id", "url").orderBy("position"))
    first = met.withColumn("a", one).filter("a = 1").withColumn("b", two).filter("b = 1")
    return first.select("message_id", "position", F.col("url").alias("listing_url"))


#: Elements of a page that are no part of its content.
FURNITURE = ("nav", "footer", "header", "form")
# Patterns of page statistics.
PAGE_PRICE = r"\$\s?([\d,]{6,})"
PAGE_BEDS = r"(?i)(\d+)\s*(?:bed(?:room)?s?|bd)"
PAGE_BATHS = r"(?i)(\d+(?:\.\d)?)\s*(?:bath(?:room)?s?|ba)"
PAGE_SQFT = r"(?i)([\d,]+)\s*(?:sq\.?\s*ft|sqft|square\s*f(?:eet|oot))"
COMPACT = r"(?i)\$\s?([\d,]{6,})\s+(\d+)\s*beds?\s+(\d+)\s*(?:bath|ba)\w*\s+([\d,]+)\s*(?:sq\.?\s*ft|sqft)"
PAGE_YEAR = r"(?i)(?:year\s*built|built\s*in|constructed)\s*:?\s*(\d{4})"
PAGE_LISTED = (
    r"(?i)(?:list(?:ed|ing)\s*(?:date|on|since)?|on\s*(?:the\s*)?market(?:\s*since)?|date\s*listed)\s*:?\s*"
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})"
)
JSON_YEAR = r'"[Yy]ear[Bb]uilt"\s*:\s*"?(\d{4})'
JSON_LISTED = (r'"[Oo]n[Mm]arket[Dd]ate"\s*:\s*"(\d{4}-\d{2}-\d{2})', r'"(?:[Ll]ist(?:ing)?[Dd]ate|[Dd]ate[Ll]isted)"\s*:\s*"(\d{4}-\d{2}-\d{2})')
JSON_LOT = r'"lotSize"\s*:\s*\{[^}]*"value"\s*:\s*([\d.]+)'
JSON_LOT_TEXT = r'(?i)"lotSize"\s*:\s*"([\d,.]+)\s*(acres?|sqft|sq\s*ft|square\s*feet)"'
LOT_TEXTS = ((r"(?i)([\d,.]+)\s*acres?\s*Lot\s*Size", 1), (r"(?i)(?<!/)([\d,.]+)\s*(?:acre|ac)s?\b", 1), (r"(?i)([\d,]+)\s*(?:sq\.?\s*ft|sqft|square\s*feet)\s+lot\b", 43560))
LEAST_HOME_PRICE = 50_000


def page_text(html: Column) -> Column:
    """Text of a page without its scripts, styles and furniture, white space squeezed."""
    return K.text_of(K.without_elements(html, FURNITURE))


def script_values(html: Column) -> Column:
    """The scripts of a page as variants, in order; null where one is no JSON."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), F.lit(1)), F.try_parse_json)


def _first_value(scripts: Column, paths: tuple[str, ...], kind: str) -> Column:
    """The first value at any of ``paths`` in any of the scripts that fits the kind."""
    at = F.transform(scripts, lambda v: F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths]))
    return F.get(F.filter(at, lambda x: x.isNotNull()), F.lit(0))


def extract_page_stats(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds price, bedrooms, bathrooms, sqft, year, list_date and lot_acres of a landed page, as page_*.

    A compact line gives what no field of its own does. The year and the list date are read from
    the text, then from JSON; a lot is JSON's number, JSON's text with a unit, then the
    text's own. JSON is read as such from scripts, and by pattern where a script is no JSON.
    """
    out = df.withColumns({"__t": page_text(F.col(html)), "__s": script_values(F.col(html))})
    t, s, raw = F.col("__t"), F.col("__s"), F.col(html)
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))
    prices = F.transform(F.regexp_extract_all(t, F.lit(PAGE_PRICE), F.lit(1)), T.number)
    sizes = F.filter(F.transform(F.regexp_extract_all(t, F.lit(PAGE_SQFT), F.lit(1)), T.number), lambda x: (x % 500 != 0) & (x >= 500) & (x <= 30000))
    compact = F.when(T.number(T.extract(t, COMPACT, 1)) >= LEAST_HOME_PRICE, T.number(T.extract(t, COMPACT, 4)))
    years = [T.extract(t, PAGE_YEAR).try_cast("long"), F.coalesce(_first_value(s, ("$.yearBuilt", "$.YearBuilt"), "long"), T.extract(raw, JSON_YEAR).try_cast("long"))]
    listed = [_first_value(s, p, "string").substr(1, 10) for p in (("$.OnMarketDate", "$.onMarketDate"), ("$.listDate", "$.ListDate", "$.listingDate", "$.ListingDate", "$.dateListed", "$.DateListed"))]
    lot = lambda value: F.when((value >= 0.01) & (value <= 1000), F.round(value, 4))
    plain = lambda x: F.regexp_replace(x, ",", "").try_cast("double")

    def worded(x: Column) -> Column:
        size = plain(T.extract(x, JSON_LOT_TEXT, 1))
        return lot(F.when(F.lower(T.extract(x, JSON_LOT_TEXT, 2)).startswith("acre"), size).otherwise(size / 43560))

    given = F.concat(F.lit('"lotSize":"'), _first_value(s, ("$.lotSize",), "string"), F.lit('"'))
    lots = [lot(F.coalesce(_first_value(s, ("$.lotSize.value",), "double"), T.extract(raw, JSON_LOT).try_cast("double"))), F.coalesce(worded(given), worded(raw))]
    lots += [lot(plain(T.extract(t, p)) / by) for p, by in LOT_TEXTS]
    return out.withColumns(
        {
            "page_price": first(prices, lambda x: x >= LEAST_HOME_PRICE),
            "page_bedrooms": T.extract(t, PAGE_BEDS).try_cast("long"),
            "page_bathrooms": T.extract(t, PAGE_BATHS).try_cast("double"),
            "page_sqft": F.coalesce(F.array_max(sizes), compact),
            "page_year": F.coalesce(*[F.when((y >= 1700) & (y <= 2030), y) for y in years]),
            "page_list_date": F.coalesce(F.trim(T.extract(t, PAGE_LISTED)), *listed, *[T.extract(raw, p) for p in JSON_LISTED]),
            "page_lot_acres": F.coalesce(*lots),
        }
    ).drop("__t", "__s")


def extract_reader_page_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Fields of a page rendered as text, adding reader_* columns."""
    b = F.col(body)
    price = T.number(T.extract(b, r"(?is)for sale\s*\$([\d,]+)"))
    size = T.number(T.extract(b, r"(?is)([\d,]+)\s*sq\s*ft"))
    year = T.extract(b, r"(?i)(\d{4})\s+Year Built").try_cast("long")
    return df.withColumns(
        {
            "reader_price": F.when(price >= 100_000, price),
            "reader_sqft": F.when((size >= 300) & (size <= 30000), size),
            "reader_bedrooms": T.extract(b, r"(?is)(\d+)\s*bd\b").try_cast("long"),
            "reader_bathrooms": T.extract(b, r"(?is)(\d+(?:\.\d)?)\s*ba\b").try_cast("double"),
            "reader_year": F.when((year >= 1800) & (year <= 2030), year),
            "reader_acres": T.extract(b, r"(?is)(\d+(?:\.\d+)?)\s*acres\s*lot size").try_cast("double"),
            "reader_tax": T.number(T.extract(b, r"(?i)Tax Annual Amount:\s*\$([\d,]+)")),
            "reader_hoa": T.number(T.extract(b, r"(?i)\$([\d,]+)/month HOA")),
        }
    )


# Where pages keep their descriptions, and words that tell one.
DESCRIPTION_SELECTORS = (
    "section#overview", "div#house-info", ".remarksContainer", "#marketing-remarks-scroll", ".remarks-container",
    '[data-rf-test-id="listingRemarks"]', '[data-testid="listing-description"]', '[id*="remarks"]', '[class*="property-details"]',
    '[class*="listing-detail"]', ".keyDetailsList", ".propertyDetailsSectionContent", ".amenity-group", "div.remarks",
    "div.description", "section.description", ".public-remarks", ".agent-remarks",
)
DESCRIPTION_WORDS = (
    "basement", "finish", "unfin", "ground floor", "ground level", "bedroom", "bath", "kitchen", "pool", "sauna", "jacuzzi",
    "hot tub", "soak", "lot", "acre", "garage", "deck", "patio", "renovated", "updated", "condition", "hardwood", "central air",
    "fireplace", "attic", "laundry", "storage", "walk-out",
)


def extract_page_description(
    html: Column, limit: int = 5000, selectors: tuple[str, ...] | list[str] = DESCRIPTION_SELECTORS, words: tuple[str, ...] = DESCRIPTION_WORDS, furniture: tuple[str, ...] = ("nav", "footer", "header")
) -> Column:
    """The longest text of 50 characters with one of ``words`` that a selector finds, cut at ``limit``.

    Where none does, the longest of 80 of any paragraph, cell or block. An element inside
    another has no more text than that, so only outermost ones are read.
    """
    content = K.without_elements(html, furniture)
    telling = "|".join(re.escape(w) for w in words)

    def longest(chosen: list[str], least: int) -> Column:
        texts = F.transform(K.elements(content, chosen, outermost=True, more=K.INLINE), K.text_of)
        good = F.filter(texts, lambda x: (F.length(x) >= least) & F.lower(x).rlike(telling))
        ranked = F.transform(good, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
        return F.array_max(ranked)["x"]

    return F.left(F.coalesce(longest(list(selectors), 50), longest(["p", "div", "section", "td", "span"], 80)), F.lit(limit))


def extract_image_urls(html: Column) -> Column:
    """Absolute image URLs in order, wide enough where a width is given, without page furniture."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    wide = F.filter(tags, lambda t: F.coalesce(T.extract(t, r'(?i)\bwidth="(\d+)').try_cast("int") >= 200, F.lit(True)))
    urls = F.transform(wide, lambda t: F.coalesce(T.extract(t, r'(?i)\ssrc="(https?://[^"]+)"'), T.extract(t, r'(?i)\sdata-src="(https?://[^"]+)"')))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & ~F.lower(u).rlike("|".join(PAGE_JUNK))))


def select_images(images: Column, k: int = 8) -> Column:
    """At most ``k`` images: the first three, the last three and two between, in order."""
    xs = F.filter(images, lambda u: ~F.lower(u).rlike("|".join(SCORING_JUNK)))
    n = F.size(xs)
    step = (n - 3 - 1 - 3) / 3.0
    inner = [F.floor(3 + step * j) for j in (1, 2)]
    keep = lambda x, i: (i < 3) | (i >= n - 3) | (i == inner[0]) | (i == inner[1])
    return F.when(n <= k, xs).otherwise(F.filter(xs, keep))


def page_status(html: Column) -> Column:
    return T.extract(html, r'(?i)"(?:SaleStatus|MlsStatus)"\s*:\s*"([^"]+)"')


# What pages say of their status, and what a bot challenge looks like.
BOT = ("tacker probe", "1x1 image", "awswaf")
PENDING_BANNER = r"(?:^|\n)\s*(?:pending|contingent)\s*(?:$|\n)"
PENDING_MARKS = ('"listingstatus":"pending"', "pending sale", "sale pending", "under contract")
SOLD_MARKS = ("sold on", "off market", "this home is no longer", "no longer for sale", "status: sold", "sale-status-sold", '"listingstatus":"sold"')
PAGE_FIELDS = r"class=\"[^\"]*(?:address-street|price|property-details|remarkscontainer)|id=\"listingremarks"


def _any(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(c, F.lit(m))
    return out


def classify_page(body: Column) -> Column:
    """error, pending, active, sold or null, from the first 5,000 characters."""
    t = F.left(F.lower(body), F.lit(5000))
    banner = F.left(t, F.lit(2500))
    return (
        F.when((F.length(t) < 200) | _any(t, BOT), "error")
        .when(banner.rlike(PENDING_BANNER) | _any(banner, PENDING_MARKS), "pending")
        .when(banner.contains("for sale"), "active")
        .when(_any(banner, SOLD_MARKS), "sold")
    )


def is_block_page(html: Column) -> Column:
    """A bot challenge: an unknown-address error without navigation or property fields."""
    t = F.lower(html)
    nav = t.rlike(r"<nav\b|class=\"header\"|id=\"header\"")
    marks = F.lower(page_text(html)).contains("unknown address") & t.contains("error")
    return F.when(F.length(page_text(html)) > 5000, False).otherwise(marks & ~nav & ~t.rlike(PAGE_FIELDS))
