"""Literal cases: input and expected value of expressions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from listingspark.functions import features as X
from listingspark.functions import text as T
from listingspark.functions.geo import haversine_m
from listingspark.operators import enrich, extract, report, tasks


def one(spark, column, **given):
    names = list(given)
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{n} {types[type(given[n])] if given[n] is not None else 'string'}" for n in names) or "x int"
    return spark.createDataFrame([tuple(given.values()) or (1,)], schema).select(column).head()[0]


@pytest.mark.parametrize(
    ("address", "town", "state", "key"),
    [
        ("10 Sherman Avenue", "Rye", "NY", "10 sherman ave|rye|ny"),
        ("10 Sherman Ave.", "Rye", "New York", "10 sherman ave|rye|ny"),
        ("5 Northeast  Oak Street", "Croton-On-Hudson", None, "5 ne oak st|croton on hudson|"),
        ("", "Rye", "NY", None),
        ("1 A St", None, "NY", None),
    ],
)
def test_address_key(spark, address, town, state, key):
    assert one(spark, T.address_key(F.col("a"), F.col("t"), F.col("s")), a=address, t=town, s=state) == key


def test_haversine(spark):
    assert 110_000 < one(spark, haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) < 112_000
    assert one(spark, haversine_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


@pytest.mark.parametrize(
    ("year", "text", "points", "tier", "condition"),
    [
        (1935, None, -6, "pre-1940", 0),
        (2010, "Gut renovated, new roof, turnkey", 0, "2005+", 6),
        (1950, "Sold as is, fixer-upper with cesspool", -5, "1940-1959", -12),
    ],
)
def test_age_condition(spark, year, text, points, tier, condition):
    got = one(spark, X.age_condition(F.col("y"), F.col("d")), y=year, d=text)
    assert (got.age_adjustment, got.age_tier, got.condition_adjustment) == (points, tier, condition)


def test_age_unknown(spark):
    got = spark.range(1).select(X.age_condition(F.lit(None).cast("long"), F.lit(None).cast("string"))).head()[0]
    assert (got.age_adjustment, got.age_tier, list(got.keywords_matched)) == (0, "unknown", [])


@pytest.mark.parametrize(
    ("text", "count", "kind"),
    [
        ("Large 2-car attached garage", 2, "attached"),
        ("Garage with 3 car space, detached", 3, "detached"),
        ("Carport only", 1, "carport"),
        ("There is no garage", 0, None),
        ("A garage, standalone", 1, "detached"),
        ("Nothing", None, None),
        (("x" * 60) + " 2 car garage " + ("y" * 60) + " attached", 2, None),
    ],
)
def test_garage(spark, text, count, kind):
    got = one(spark, X.garage(F.col("d")), d=text)
    assert (got.garage_count, got.garage_type) == (count, kind)


@pytest.mark.parametrize(
    ("text", "monthly", "annual"),
    [
        ("HOA $350/mo", 350, None),
        ("hoa dues $400 annually", None, 400),
        ("No HOA here", 0, None),
        ("$3,600/year", None, 3600),
        ("$5/mo", None, None),
    ],
)
def test_hoa(spark, text, monthly, annual):
    got = one(spark, X.hoa(F.col("d")), d=text)
    assert (got.hoa_monthly, got.hoa_annual) == (monthly, annual)


@pytest.mark.parametrize(
    ("price", "sqft", "value", "signal", "ppsf"),
    [(600000.0, 2000.0, 1_200_000.0, "below_market", 300.0), (900000.0, 1500.0, 900_000.0, "at_market", 600.0)],
)
def test_price_signal(spark, price, sqft, value, signal, ppsf):
    got = one(spark, enrich.price_signal(F.col("p"), F.col("s"), F.col("v")), p=price, s=sqft, v=value)
    assert (got.signal, got.ppsf) == (signal, ppsf)


def test_reader_page_ignores_low_prices(spark):
    rows = spark.createDataFrame([("For sale\n\n$99,000",), ("FOR SALE\n\n$1,200,000",)], "body string")
    assert [r.reader_price for r in extract.extract_reader_page_fields(rows).collect()] == [None, 1_200_000]


def test_processing_state(spark):
    hard = "array<struct<criterion:string,passed:boolean,value:string,reason:string>>"
    rows = [(["Pending enrichment"], "ai"), (["Pending enrichment"], "ai_failed"), (["pending enrichment"], "ai"), ([], "ai")]
    df = spark.createDataFrame([(c, m, [], "high") for c, m in rows], f"concerns array<string>, evaluation_method string, hard_results {hard}, confidence string")
    assert [r.pending for r in report.processing_state(df).collect()] == [True, False, False, False]


def test_requeue(spark):
    have = spark.createDataFrame([(1, "stats", "done", 1), (1, "status", "failed", 3), (2, "stats", "running", 1)], "listing_id long, task_type string, status string, attempts long")
    want = spark.createDataFrame([(1, "stats"), (1, "status"), (2, "stats"), (3, "stats"), (3, "stats")], "listing_id long, task_type string")
    got = {(r.listing_id, r.task_type): (r.status, r.attempts) for r in tasks.requeue(have, want).collect()}
    assert got == {(1, "stats"): ("pending", 0), (1, "status"): ("pending", 2), (2, "stats"): ("running", 1), (3, "stats"): ("pending", 0)}
    assert {(r.status, r.attempts) for r in tasks.requeue(have, want, True).filter("task_type = 'status'").collect()} == {("pending", 0)}


def test_select_images_spreads(spark):
    urls = [f"https://x/{i}.jpg" for i in range(20)]
    df = spark.createDataFrame([(urls,)], "u array<string>")
    got = df.select(extract.select_images(F.col("u"))).head()[0]
    assert len(got) == 8 and got[:3] == urls[:3] and got[-3:] == urls[-3:]


def test_nearest_by_grid_equals_broadcast(spark, monkeypatch):
    points = spark.createDataFrame([(i, 40.9 + (i * 37 % 100) / 200, -73.9 + (i * 53 % 100) / 200) for i in range(60)] + [(99, None, None)], "listing_id long, lat double, lng double")
    stations = spark.createDataFrame([(i, f"s{i}", 40.8 + (i * 17 % 50) / 60, -74.0 + (i * 29 % 50) / 60) for i in range(25)], "idx long, name string, lat double, lng double")
    whole = sorted(map(tuple, enrich.nearest_station(points, stations).select("listing_id", "station", "station_m").collect()), key=str)
    monkeypatch.setattr(enrich, "BROADCAST_STATIONS", 1)
    grid = sorted(map(tuple, enrich.nearest_station(points, stations).select("listing_id", "station", "station_m").collect()), key=str)
    assert whole == grid and not math.isnan(whole[0][2])


def test_remote_rows_get_their_nearest_station_by_the_grid_too(spark, monkeypatch):
    stations = spark.createDataFrame([(0, "A", 41.0, -73.7), (1, "B", 41.2, -73.5), (2, "C", 10.0, 179.9)], "idx long, name string, lat double, lng double")
    points = spark.createDataFrame([(1, 41.0, -73.6), (2, 5.0, -30.0), (3, 10.0, -179.9), (4, 60.0, -100.0), (5, None, 1.0)], "listing_id long, lat double, lng double")
    found = []
    for most in (5_000, 1):
        monkeypatch.setattr(enrich, "BROADCAST_STATIONS", most)
        found.append({r.listing_id: (r.station, r.station_m) for r in enrich.nearest_station(points, stations).collect()})
    assert found[0] == found[1] and found[1][3][0] == "C" and found[1][2][0] is not None and found[1][5] == (None, None)


def test_listing_falls_back_to_text_where_markup_has_no_block(spark):
    text = "12 Oak Street\nRye, New York 10573\n$900,000\n3 bd 2 ba\nMLS #123456"
    rows = [("a", "only sold", '<p class="highlight-price">$1</p>', text), ("b", "x", "<p>hi</p>", "no listing"), ("c", "x", '<div class="multiLineDisplay"><span class="highlight-price">$5,000</span></div>', text), ("d", None, None, None)]
    got = {r.message_id: (r.source_format, r.price, r.address, r.listing_status) for r in extract.extract_listings(spark.createDataFrame(rows, "message_id string, subject string, html string, text string")).collect()}
    assert got == {"a": ("plaintext", 900_000, "12 Oak Street", "Sold"), "b": ("none", None, None, None), "c": ("html", 5000, None, None), "d": ("none", None, None, None)}


@pytest.mark.parametrize(
    ("text", "commute"),
    [("Reject over 90 min. A commute of 110 min is too long.", 90), ("A commute of 110 min. Reject over 90 min.", 110), ("No limit", None)],
)
def test_commute_limit_is_the_first_in_the_text(spark, text, commute):
    from listingspark.operators import score

    df = spark.createDataFrame([(1, text)], "version long, instructions string")
    assert score.criteria_thresholds(df).head().commute == commute


def test_tax_falls_back_to_the_towns_own_county(spark):
    homes = spark.createDataFrame([(1, "5 Oak St", "Rye"), (2, "5 Oak St", "Buffalo"), (3, "5 Oak St", "Queens"), (4, "7 Elm Rd", "Rye")], "listing_id long, address string, town string")
    rolls = spark.createDataFrame([(1, "Erie", "Amherst", "5", "OAK ST", 10, 0), (2, "Westchester", "Harrison", "5", "OAKLAND", 20, 40)], "parcel_id long, county string, municipality string, number string, street string, assessed long, market long")
    counties = spark.createDataFrame([("buffalo", "Erie")], "town string, county string")
    nyc = spark.createDataFrame([(1, "4", "5 OAK ST APT 2", 0, 7)], "row_id long, boro string, address string, assessed long, market long")
    towns = spark.createDataFrame([], "town string, municipality string")
    got = {r.listing_id: (r.assessed, r.market, r.tier) for r in enrich.property_tax(homes, rolls, counties, nyc, towns).collect()}
    assert got == {1: (20, 40, "county"), 2: (10, None, "county"), 3: (None, 7, "city")}


def test_lots_by_compound_names_and_beginnings(spark):
    homes = spark.createDataFrame([(1, "5 Lakeshore Dr", "Rye", "NY"), (2, "6 N Main St", "Rye", "NY"), (3, "5 Lakeshore Dr", "Rye", "NJ"), (4, "Nowhere", "Rye", "NY")], "listing_id long, address string, town string, state string")
    parcels = spark.createDataFrame([(1, "Westchester", "5", "LAKE SHORE DR", "Elsewhere", "Elsewhere", 0.0, 1.5), (2, "Westchester", "6", "NORTH MAIN ST", "Town of Rye", "", 0.0, 0.0), (3, "Westchester", "6", "NORTH END", "Rye", "", 2.0, 0.0)], "parcel_id long, county string, number string, street string, municipality string, city_town string, acres double, calc_acres double")
    got = {r.listing_id: r.lot_acres for r in enrich.parcel_lot_acres(homes, parcels, spark.createDataFrame([], "town string, county string")).collect()}
    assert got == {1: 1.5, 2: 2.0}


def test_alert_text_and_departure_slot(spark):
    from listingspark.operators import alerts

    df = spark.createDataFrame([(1, 81, "5 Oak St", "Rye", "Active", 1_250_000, 3, None, 45)], "listing_id long, score long, address string, town string, listing_status string, price long, bedrooms long, sqft long, commute_minutes long")
    r = alerts.alert_text(df).head()
    assert (r.headline, r.stats) == ("81/100 - 5 Oak St - Rye", "$1,250,000 | 3 bd | 45 min | Active")
    slots = {"2026-01-09 20:00:00": "2026-01-12 13:00:00", "2026-07-07 12:00:00": "2026-07-08 12:00:00", "2026-01-10 03:00:00": "2026-01-12 13:00:00"}
    for now, want in slots.items():
        got = spark.sql(f"select timestamp '{now}' as ts").select(enrich.departure_slot(F.col("ts")).cast("string")).head()[0]
        assert got == want


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from listingspark.plans.streams import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_payload_holds_what_is_known(spark):
    import json

    from listingspark.operators import score

    df = spark.sql("select 1L as listing_id, '5 Oak St' as address, 'Rye' as town, 'NY' as state, 900000L as price, 2000L as sqft, 3L as bedrooms, 1990L as year_built, 'Two-car attached garage.' as description, 450.0d as ppsf, 'at_market' as signal, cast(null as string) as zone, cast(null as boolean) as sfha, array('a.jpg') as images, 45L as commute_minutes")
    got = json.loads(score.build_scoring_payload(df).head().payload)
    assert got["price"] == 900000 and got["price_per_sqft"] == {"ppsf": 450.0, "signal": "at_market"}
    assert got["commute"] == {"commute_minutes": 45} and "flood" not in got and "pool" not in got
    assert got["evidence"] == {"images": ["a.jpg"], "description": "Two-car attached garage."}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("$1,200,000 4 Beds 2.5 Baths 3,034 sqft\n12 Main Street, Suite 100| White Plains, NY 10601", {"address": "12 Main Street, Suite 100", "town": "White Plains", "state": "NY", "zip_code": "10601"}),
        ("$1,200,000 4 Beds\n31 Lalli Dr, Katonah, NY 10536\nStyle: Colonial\nListed: 01/15/2025\n0.25 acres lot", {"address": "31 Lalli Dr", "property_type": "Single Family Residential", "list_date": "2025-01-15", "lot_acres": 0.25}),
        ("$750,000 MLS #112233\nProperty Type: Condominium\nActive since: Feb 3, 2025", {"property_type": "Condo/Co-op", "list_date": "2025-02-03", "mls_id": "112233"}),
        ("$850,000 MLS #445566\nType: Townhouse\nDate Listed: January 15, 2025", {"property_type": "Townhouse", "list_date": "2025-01-15"}),
        ("$1,100,000 MLS #778899\nSingle Family\nListed on 2025-03-10\n10,890 sq ft lot", {"property_type": "Single Family Residential", "list_date": "2025-03-10", "lot_acres": 0.25}),
        ("$900,000 MLS #1\nnear 10510", {"property_type": None, "list_date": None, "zip_code": "10510", "town": None}),
    ],
)
def test_plain_alerts(spark, body, want):
    from listingspark.operators.extract import extract_listings

    row = extract_listings(spark.createDataFrame([("m", "s", "", body)], "message_id string, subject string, html string, text string")).head()
    assert {k: row[k] for k in want} == want


def test_urls_of_the_markup_serve_once_and_in_order(spark):
    from listingspark.operators.extract import extract_listings

    text = "$900,000 MLS #1\n5 Oak St, Rye, NY 10580\n\n$910,000 MLS #2\n5 Oak St, Rye, NY 10580\n\n$920,000 MLS #3\n6 Elm Ave., Rye, NY 10580"
    html = "".join(f'<a href="https://www.redfin.com/NY/Rye/{s}/home/{i}">x</a>' for i, s in enumerate(["5-Oak-St-10580", "5-Oak-St-10580", "6-Elm-Ave-10580", "5-Oak-St-10580"]))
    rows = extract_listings(spark.createDataFrame([("m", "s", html, text)], "message_id string, subject string, html string, text string")).orderBy("position").collect()
    assert [r.listing_url.rsplit("/", 1)[1] for r in rows] == ["0", "1", "2"]


def test_feature_bits_equal_the_patterns(spark):
    from listingspark.functions import features as X

    words = "Solar panels|geo-thermal|high efficiency|energy star|upgraded systems|water view|hill view|skyline|fenced lot|private fence|screened porch|mature landscaping|wooded lot|corner property|pool table|above ground pool|walk-out lower|downstairs suite|slab foundation|no basement|finished basement|Built in 1950|1960 year built|listed on 2026-01-05|on market since March 3, 2025|nothing"
    df = spark.createDataFrame([(f"{a}. {b}",) for a in words.split("|") for b in words.split("|")] + [(None,), ("",)], "d string")
    d = F.col("d")
    plain = {n: X.flag(d, n) for n in X.FLAGS} | {"has_pool": X.pool(d)["has_pool"], "has_basement": X.basement(d)["has_basement"], "year_built": X.year_built(d).isNotNull(), "list_date": X.list_date(d).isNotNull()}
    rows = df.select(X.feature_bits(F.lower("d")).alias("bits"), *[F.coalesce(plain[n], F.lit(False)).alias(n) for n in X.TELLS]).collect()
    for r in rows:
        assert [bool(r.bits >> k & 1) for k in range(len(X.TELLS))] == [r[n] for n in X.TELLS]
