"""Views, quality figures and reports over listings and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators.tables import populated

QUALITY_FIELDS = ("address", "town", "state", "zip_code", "price", "sqft", "bedrooms", "year_built", "commute_minutes", "listing_url", "description")
CONFIDENCE_WEIGHTS = {"description": 20, "images": 15, "schools": 15, "commute_minutes": 15, "year_built": 10, "lot_acres": 8, "basement": 7, "tax": 5, "garage": 5}


def scored_listings(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """All listings with their score, newest first."""
    detail = scores.select("listing_id", "verdict", "confidence", "evaluation_method", F.col("score").alias("model_score"))
    return listings.join(detail, "listing_id", "left").orderBy(F.col("created_at").desc(), F.col("listing_id").desc())


def listing_lookup(df: DataFrame, mls_id: str) -> DataFrame:
    return df.filter(F.col("mls_id") == mls_id)


def _off(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("pending", "sold", "closed", "under contract")


def view_tests(hide_low: bool = False) -> dict[str, Column]:
    """The predicate of each dashboard view."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    shown = ~F.col("verdict").isin("Weak Match", "Reject") if hide_low else F.lit(True)
    shown = F.coalesce(shown, F.lit(True))
    return {
        "active": ~yes("passed") & ~yes("toured") & ~_off(F.col("listing_status")) & shown,
        "all": shown,
        "strong": F.coalesce(F.col("verdict").isin("Strong Match", "Worth Touring"), F.lit(False)),
        "toured": yes("toured"),
        "liked": yes("liked"),
        "want_to_go": yes("tour_requested"),
        "passed": yes("passed"),
    }


def view(df: DataFrame, name: str, hide_low: bool = False) -> DataFrame:
    return df.filter(view_tests(hide_low)[name])


def view_counts(df: DataFrame, hide_low: bool = False) -> DataFrame:
    """Rows of each view, all counted in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in view_tests(hide_low).items()])


SORTS = {
    "score_desc": lambda: F.col("score").desc_nulls_last(),
    "score_asc": lambda: F.col("score").asc_nulls_last(),
    "price": lambda: F.col("price").asc_nulls_last(),
    "sqft": lambda: F.col("sqft").desc_nulls_last(),
    "ppsf": lambda: F.expr("try_divide(price, sqft)").asc_nulls_last(),
    "newest": lambda: F.col("created_at").desc_nulls_last(),
    "commute": lambda: F.col("commute_minutes").asc_nulls_last(),
    "schools": lambda: F.col("best_school").desc_nulls_last(),
}


def sort_by(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(SORTS[key](), "listing_id")


def processing_state(df: DataFrame) -> DataFrame:
    """Adds pending and uncertain, from the parsed score columns."""
    waiting = (F.array_join("concerns", "\x00") == "Pending enrichment") & (F.col("evaluation_method") != "ai_failed")
    unknown = F.size(F.filter("hard_results", lambda x: x["passed"].isNull()))
    return df.withColumns({"pending": F.coalesce(waiting, F.lit(False)), "uncertain": (F.col("confidence") == "low") | (unknown >= 2)})


def days_on_market(listed: Column, as_of: Column) -> Column:
    return F.datediff(as_of, listed)


def price_per_sqft(price: Column, sqft: Column) -> Column:
    return F.when(sqft > 0, F.bround(price / sqft, 2))


def quality_pct(df: DataFrame, fields: tuple[str, ...] = QUALITY_FIELDS) -> DataFrame:
    """Percentage of populated cells; 100 for an empty table."""
    cells = reduce(lambda a, b: a + b, [populated(F.col(c)).cast("int") for c in fields])
    return df.agg(F.coalesce(F.round(F.sum(cells) / (F.count("*") * len(fields)) * 100, 2), F.lit(100.0)).alias("quality_pct"))


def weighted_confidence(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds data_confidence (0 to 100) and colour from which kinds of data a row has."""
    total = sum(CONFIDENCE_WEIGHTS[n] for n in tests)
    got = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") * CONFIDENCE_WEIGHTS[n] for n, c in tests.items()])
    pct = F.floor(got * 100 / total)
    return df.withColumns({"data_confidence": pct, "colour": F.when(pct >= 80, "green").when(pct >= 60, "yellow").otherwise("red")})


def field_coverage(df: DataFrame, fields: tuple[str, ...] = QUALITY_FIELDS) -> DataFrame:
    wide = df.agg(*[F.round(F.avg(populated(F.col(c)).cast("int")) * 100, 2).alias(c) for c in fields])
    return wide.select(F.lit(0).alias("k"), "*").unpivot(["k"], list(fields), "field", "pct").drop("k")


def data_quality_rows(df: DataFrame) -> DataFrame:
    """(listing_id, issue) of rows without an address, a URL or a town."""
    missing = F.array_compact(F.array(*[F.when(T.blank(F.trim(c)), F.lit(f"missing_{c}")) for c in ("address", "listing_url", "town")]))
    return df.select("listing_id", F.explode(missing).alias("issue"))


def data_quality_report(df: DataFrame) -> DataFrame:
    """(issue, n, first_id) for rows without an address, a URL or a town."""
    return data_quality_rows(df).groupBy("issue").agg(F.count("*").alias("n"), F.min("listing_id").alias("first_id"))


def fix_data_quality(df: DataFrame) -> DataFrame:
    """``df`` without rows that have no address; blank towns, states and zips from the URL."""
    from listingspark.operators.extract import slug_fields

    found = slug_fields(F.col("listing_url"))
    fill = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), found[c]) for c in ("town", "state", "zip_code")}
    return df.filter(~T.blank(F.trim("address"))).withColumns(fill)


def _unknown() -> Column:
    return F.exists("hard_results", lambda x: x["passed"].isNull())


def image_audit(listings: DataFrame, scores: DataFrame, images: str = "n_images") -> DataFrame:
    out = listings.join(scores.select("listing_id", "hard_results"), "listing_id", "left")
    has, unknown = F.coalesce(F.col(images) > 0, F.lit(False)), F.coalesce(_unknown(), F.lit(False))
    return out.agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_images"), F.count_if(~has).alias("without_images"),
        F.count_if(unknown).alias("with_unknowns"), F.count_if(unknown & ~has).alias("unknown_without_images"),
    )


def unknown_without_images(listings: DataFrame, scores: DataFrame, images: str = "n_images", n: int = 20) -> DataFrame:
    """The ``n`` best scored of the listings with an unknown result and no image."""
    out = listings.join(scores.select("listing_id", "hard_results"), "listing_id").filter(_unknown() & ~F.coalesce(F.col(images) > 0, F.lit(False)))
    return out.select("listing_id", "score").orderBy(F.col("score").desc_nulls_last(), "listing_id").limit(n)


def rescrape_targets(listings: DataFrame, scores: DataFrame, images: str = "n_images") -> DataFrame:
    out = listings.join(scores.select("listing_id", "hard_results"), "listing_id")
    return out.filter(_unknown() & (F.coalesce(F.col(images), F.lit(0)) < 3)).select("listing_id")


def sender_counts(messages: DataFrame, listings: DataFrame) -> DataFrame:
    """(sender, n) listings of each sender, those without one too, most first."""
    out = messages.join(listings.select("listing_id", F.lit(1).alias("hit")), "listing_id", "left")
    return out.groupBy("sender").agg(F.count("hit").alias("n")).orderBy(F.col("n").desc(), "sender")


def recent_messages(messages: DataFrame, limit: int = 50) -> DataFrame:
    return messages.orderBy(F.col("ts").desc(), F.col("message_id").desc()).limit(max(1, min(100, limit)))


def missing_status_with_subject(listings: DataFrame, messages: DataFrame) -> DataFrame:
    """Listings without a status and their message's subject, by score; with the status it states."""
    out = listings.filter(T.blank(F.col("listing_status"))).join(messages.select("listing_id", "subject"), "listing_id")
    return out.select("listing_id", "score", "subject", T.status_from_subject(F.col("subject")).alias("new_status")).orderBy(F.col("score").desc_nulls_last(), "listing_id")


def top_live(df: DataFrame) -> DataFrame:
    live = df.filter(T.is_live(F.col("listing_status")) & (F.col("score") > 0))
    return live.orderBy(F.col("score").desc(), "listing_id").limit(1)
