"""Column expressions over strings: keys, URLs, dates, statuses and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingspark.config import LIVE_EVENTS, MARKET_LIVE, OFF_MARKET

# Street suffixes, directions and states of the address key.
SUFFIXES = {
    "street": "st", "avenue": "ave", "lane": "ln", "drive": "dr", "road": "rd", "court": "ct", "place": "pl",
    "circle": "cir", "boulevard": "blvd", "terrace": "ter", "parkway": "pkwy", "highway": "hwy", "trail": "trl",
    "crossing": "xing", "turnpike": "tpke", "expressway": "expy", "way": "way",
}
DIRECTIONS = {
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
STATES = {"new york": "ny", "new jersey": "nj", "connecticut": "ct", "pennsylvania": "pa", "massachusetts": "ma"}
# Property types; an exact match wins, else the first prefix in this order.
SINGLE, CONDO, TOWN, MULTI, MOBILE = "Single Family Residential", "Condo/Co-op", "Townhouse", "Multi-Family", "Mobile/Manufactured Home"
PROPERTY_TYPES = (
    ("single family residential", SINGLE), ("single family home", SINGLE), ("single family", SINGLE),
    ("single-family residential", SINGLE), ("single-family home", SINGLE), ("single-family", SINGLE), ("residential", SINGLE),
    ("condominium", CONDO), ("condo", CONDO), ("co-op", CONDO), ("co op", CONDO), ("coop", CONDO),
    ("townhouse", TOWN), ("townhome", TOWN),
    ("multi-family", MULTI), ("multi family", MULTI), ("multifamily", MULTI), ("two-family", MULTI), ("two family", MULTI),
    ("colonial", SINGLE), ("ranch", SINGLE), ("cape cod", SINGLE), ("split level", SINGLE), ("split-level", SINGLE),
    ("contemporary", SINGLE), ("victorian", SINGLE), ("tudor", SINGLE), ("farmhouse", SINGLE), ("craftsman", SINGLE),
    ("mobile home", MOBILE), ("manufactured home", MOBILE), ("mobile-home", MOBILE), ("manufactured-home", MOBILE),
)
LIST_URL = r"(?i)https?://(?:www\.)?(?:redfin\.com/[A-Z]{2}/[^/]+/[^/]+/\S+|onekeymls\.com/listing/\S+|onehome\.com/\S+)"
LOT_ACRES = r"(?i)(?<!/)([\d,.]+)\s*(?:acre|ac)s?\b"
LOT_FEET = r"(?i)([\d,]+)\s*(?:sq\.?\s*ft|sqft|square\s+feet)\s+lot\b"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null where the pattern does not match."""
    return none_if_empty(F.regexp_extract(c, pattern, group))


def extract_once(c: Column, pattern: str, group: int = 1) -> Column:
    """As ``extract``, matched once also where expressions are not shared, as in lambdas."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda x: x != ""), F.lit(0))


def number(c: Column) -> Column:
    """Digits with thousands commas as a whole number, else null."""
    return F.regexp_replace(c, ",", "").try_cast("long")


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.translate(F.trim(F.lower(c)), ".", ""), "-", " "), r"\s+", " ")


def address_key(address: Column, town: Column, state: Column) -> Column:
    """Normalised ``address|town|state``; null without an address or a town."""
    a = _squeezed(address)
    for long, short in [*SUFFIXES.items(), *sorted(DIRECTIONS.items(), key=lambda x: -len(x[0]))]:
        a = F.regexp_replace(a, rf"\b{long}\b", short)
    s = F.translate(F.trim(F.lower(F.coalesce(state, F.lit("")))), ".", "")
    codes = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.when(~blank(address) & ~blank(town), F.concat_ws("|", a, _squeezed(town), F.coalesce(codes[s], s)))


def home_id(url: Column) -> Column:
    return extract(url, r"/home/(\d+)")


def clean_listing_url(url: Column) -> Column:
    """Portal URLs without their query string and with https; others unchanged."""
    return F.when(url.contains("redfin.com"), F.regexp_replace(F.substring_index(url, "?", 1), "^http://", "https://")).otherwise(url)


def fold_place(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def parse_duration(c: Column) -> Column:
    """Seconds of "123.5s", rounded half to even; 0 where missing or malformed."""
    return F.coalesce(F.bround(F.rtrim(c, F.lit("s")).try_cast("double")).cast("long"), F.lit(0).cast("long"))


def strip_json_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def mask_email(c: Column) -> Column:
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1)))


def status_from_subject(c: Column) -> Column:
    s = F.lower(c)
    kinds = ("sold", "pending", "active")
    hits = [s.contains(f"only {k}") for k in kinds]
    out = F.when(hits[0], "Sold").when(hits[1], "Pending").when(hits[2], "Active")
    return out


def status_class(c: Column) -> Column:
    """live_market, live_event, off_market or unknown."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(s.isin(*MARKET_LIVE), "live_market").when(s.isin(*LIVE_EVENTS), "live_event").when(s.isin(*OFF_MARKET), "off_market").otherwise("unknown")
    )


def is_live(c: Column) -> Column:
    return status_class(c).isin("live_market", "live_event")


def is_market_state(c: Column) -> Column:
    return status_class(c).isin("live_market", "off_market")


def canonical_property_type(c: Column) -> Column:
    """The name of a type by its whole text, else by the first in the table that begins it, else the text in title case."""
    s = F.lower(F.trim(c))
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(name).alias("name")) for key, name in PROPERTY_TYPES])
    first = lambda test: F.get(F.filter(table, test), F.lit(0))["name"]
    known = F.coalesce(first(lambda x: s == x["key"]), first(lambda x: F.startswith(s, x["key"])))
    return F.when(~blank(F.trim(c)), F.coalesce(known, F.initcap(F.trim(c))))


def parse_list_date_text(c: Column) -> Column:
    """ISO, M/D/Y or M-D-Y with two or four digits, "Month D, Y" long or short; else null."""
    s = F.trim(c)
    slashed = F.regexp_replace(s, "-", "/")
    two = F.regexp_replace(slashed, r"^(\d{1,2}/\d{1,2})/(\d{2})$", "$1/20$2")
    worded = F.initcap(F.regexp_replace(F.regexp_replace(s, r"[.,]", " "), r"\s+", " "))
    tries = [
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))),
        F.when(two.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(two, F.lit("M/d/yyyy"))),
        F.when(worded.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"), F.try_to_timestamp(worded, F.lit("MMM d yyyy"))),
        F.when(worded.rlike(r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$"), F.try_to_timestamp(worded, F.lit("MMMM d yyyy"))),
    ]
    return F.coalesce(*tries).cast("date")


def parse_lot_acres(c: Column) -> Column:
    """Acres, not those of a fraction, else square feet of lot; 0.01 to 1000, four digits."""
    acres = F.regexp_replace(extract(c, LOT_ACRES), ",", "").try_cast("double")
    feet = number(extract(c, LOT_FEET)) / 43560.0
    inside = lambda x: F.when((x >= 0.01) & (x <= 1000), x)
    return F.round(F.coalesce(inside(acres), inside(feet)), 4)
