"""Enrichment keeps rows, continues where an earlier run stopped, and survives odd places."""

import math
import random
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from listingspark.operators import enrich as E
from listingspark.operators import resolve as R
from listingspark.operators import score as C
from listingspark.plans.queries_enrich import references
from listingspark.registry import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def homes(spark):
    v = Views(spark, SF)
    rows = v("half_filled_v").filter("listing_id % 4 = 1")
    return rows.withColumn("lat", F.when(F.col("listing_id") % 15 != 2, F.col("lat"))), references(v, v("homes_v").filter("listing_id % 15 <> 2"))


def told(df):
    return sorted((tuple(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect()), key=str)


def test_a_second_run_changes_nothing_and_asks_nothing(spark, homes, tmp_path):
    df, refs = homes
    E.enrich_all(df, refs).write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    again = E.enrich_all(once, refs)
    assert once.select("signal").distinct().count() > 1
    assert sorted(again.columns) == sorted(once.columns)
    assert told(again) == told(once)
    # rows without a place or a town may be asked about later; no other reaches a lookup again
    able = once.filter("lat is not null and town is not null")
    assert able.count() > 100
    assert E.place_answers(able, E.lookups(refs)).count() == 0
    asked = E.lookups(refs)[0].asked(once.columns)
    assert once.filter(asked).count() == 0


def test_lookups_see_only_distinct_places_that_are_not_marked(spark):
    rows = [(1, "1 A St", "Rye", None), (2, "1 A St", "Rye", None), (3, "2 B St", "Rye", True), (4, "2 B St", None, None), (5, "3 C St", "Rye", False)]
    df = spark.createDataFrame(rows, "listing_id long, address string, town string, probe_checked boolean")
    df = df.withColumns({"state": F.lit("NY"), "zip_code": F.lit("10580"), "lat": F.lit(41.0), "lng": F.lit(-73.0), "value": F.when(F.col("listing_id") == 5, F.lit(9))})
    seen = []

    def find(places):
        seen.extend(sorted((r.address, r.town) for r in places.collect()))
        return places.filter("address = '9'").select("listing_id", F.lit(7).alias("value"))

    probe = E.Lookup("probe", ("town",), ("value",), ("value",), find)
    answers = E.place_answers(df, [probe])
    assert seen == [("1 A St", "Rye")]
    out = df.withColumn("__place", E._place_key()).join(answers, "__place", "left").withColumns(E._fills(probe, df.columns, {"value": "int"}))
    assert {r.listing_id: (r.value, r.probe_checked) for r in out.collect()} == {1: (None, True), 2: (None, True), 3: (None, True), 4: (None, False), 5: (9, False)}


def test_lookups_are_asked_about_what_they_go_by(spark):
    """Places that differ in other columns only are asked about once, and one reading of the places serves all lookups."""
    df = spark.range(60).selectExpr("id as listing_id", "concat(id, ' A St') as address", "'Rye' as town", "'NY' as state", "'10580' as zip_code", "if(id = 0, null, 41.0D) as lat", "-73.0D as lng")
    seen = []

    def find(places):
        seen.append(sorted((r.lat, r.lng) for r in places.collect()))
        return places.filter("lat = 41").select("listing_id", F.lit(7).alias("value"))

    point = ("lat", "lng")
    probes = [E.Lookup(n, point, ("value",), ("value",), find, point) for n in ("one", "two")]
    answers = E.place_answers(df, probes, point)
    assert seen == [[(41.0, -73.0)]] * 2
    out = df.withColumn("__place", E._place_key(point)).join(answers, "__place", "left").collect()
    assert {(r.listing_id > 0, r["__one"] and r["__one"].value, r["__two"] and r["__two"].value) for r in out} == {(False, None, None), (True, 7, 7)}
    assert {x.name: x.by for x in E.lookups(E.References(*[None] * 15))}["zone"] == point
    answers.collect()
    assert "ReusedExchange" in answers._jdf.queryExecution().executedPlan().toString()


def test_repeated_reference_rows_keep_the_row_count(spark, homes):
    df, refs = homes
    few = df.filter("listing_id % 16 = 1")
    twice = E.References(**{f.name: getattr(refs, f.name).unionByName(getattr(refs, f.name)) for f in fields(refs)})
    out = E.enrich_all(few, twice)
    assert out.count() == few.count() == out.select("listing_id").distinct().count()
    same = lambda x: {r.listing_id: (r.station, r.station_m, r.n_features, r.zone, r.tier, r.commute_minutes, r.signal, r.lot_acres) for r in x.collect()}
    assert same(out) == same(E.enrich_all(few, refs))


def test_station_columns_are_filled_as_one(spark, homes):
    df, refs = homes
    given = df.filter("listing_id % 11 = 0 and lat is not null")
    rows = E.enrich_all(given, refs).select("listing_id", "station", "station_m").collect()
    assert {r.station == "Old Station" for r in rows if r.listing_id % 22} == {False}
    assert {(r.station, r.station_m) for r in rows if r.listing_id % 22 == 0} <= {("Old Station", 77)}


def test_commute_keeps_one_row_for_several_legs(spark):
    df = spark.createDataFrame([(1, "Rye", 41.0, -73.7), (2, "Rye", 41.0, -73.7), (3, None, 41.0, -73.7)], "listing_id long, town string, lat double, lng double")
    stations = spark.createDataFrame([(0, "Rye", 41.01, -73.7)], "idx long, name string, lat double, lng double")
    drives = spark.createDataFrame([(1, "Rye", 900, 3000.0), (1, "Harrison", 60, 100.0), (1, "Rye", 600, 2500.0), (1, "Rye", 0, 1.0), (2, "Harrison", 60, 100.0)], "listing_id long, station string, drive_s long, road_m double")
    transits = spark.createDataFrame([("Rye", 2400), ("Rye", 2100), ("Rye", None)], "station string, transit_s long")
    overrides = spark.createDataFrame([("x", "y")], "town string, station_town string")
    got = sorted(map(tuple, E.commute(df, stations, overrides, drives, transits).collect()))
    assert got == [(1, "Rye", 45, None), (2, "Rye", None, "missing_leg"), (3, None, None, "no_station")]


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [300.0, 4000.0])
def test_radius_round_poles_and_the_date_line(spark, radius):
    rng = random.Random(int(radius))
    near = radius / 111_000
    centres = [(90.0, 0.0), (-90.0, 50.0), (89.999, 179.9), (84.99, 10.0), (85.01, 10.0), (0.0, 180.0), (60.0, -180.0), (41.0, -73.0), (-84.999, -180.0)]
    around = lambda y, x: (max(-90.0, min(90.0, y + rng.uniform(-2, 2) * near)), (x + rng.uniform(-2, 2) * near / max(0.02, math.cos(math.radians(y))) + 180) % 360 - 180)
    homes = [(i, *(c if k == 0 else around(*c))) for i, (c, k) in enumerate((c, k) for c in centres for k in range(12))]
    poles = [(i, "tower", 1, *around(*c)) for i, c in enumerate(c for c in centres for _ in range(25))]
    odd = [(900, None, 1.0), (901, 91.0, 0.0), (902, 5.0, float("nan")), (903, float("inf"), 3.0)]
    df = spark.createDataFrame(homes + odd, "listing_id long, lat double, lng double")
    features = spark.createDataFrame([*poles, (999, "tower", 1, None, None), (998, "tower", 1, 95.0, 0.0)], "feature_id long, kind string, voltage long, lat double, lng double")
    want = {i: sum(metres(y, x, p[3], p[4]) <= radius for p in poles) for i, y, x in homes} | {i: 0 for i, *_ in odd}
    assert {r.listing_id: r.n_features for r in E.within_radius(df, features, radius).collect()} == want
    assert sum(want.values()) > 50


def rows_joined(df):
    """Rows out of each join of a collected DataFrame, from the plan's own counts."""
    joined = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return joined


def test_many_rows_and_features_at_one_place_do_not_multiply(spark):
    rng = random.Random(5)
    spot = lambda: (41 + rng.randrange(8) / 1000, -73 + rng.randrange(8) / 1000)
    line = [(41.0, -73.0), (41.0007, -72.9995), (41.0014, -72.999)]
    homes = [(i, 41.001, -73.001) for i in range(1500)] + [(i, *spot()) for i in range(1500, 1600)]
    # keys with two places, a row that stands twice, and rows without a key or a place
    homes += [(1500, 41.0, -73.0), (1501, 41.003, -73.0), (1501, 41.003, -73.0), (1, 41.001, -73.001), (None, 41.0, -73.0), (1700, None, -73.0)]
    lines = [(i, "line", None if i % 2 else i % 7, *p) for i in range(1000) for p in line]
    lines += [(i, rng.choice(["tower", "line"]), rng.randrange(3), *spot()) for i in range(1000, 1060) for _ in range(rng.randrange(1, 4))]
    lines += [(None, "tower", 5, *spot()) for _ in range(6)] + [(3, "tower", 1, *line[0])]
    df = spark.createDataFrame(homes, "listing_id long, lat double, lng double")
    features = spark.createDataFrame(lines, "feature_id long, kind string, voltage long, lat double, lng double")
    order = lambda x: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in x)
    places = {}
    for i, y, x in homes:
        places.setdefault(i, set()).add((y, x))

    def want(i):
        near = [(metres(*p, f[3], f[4]), f[0], f[1], f[2]) for p in places[i] if None not in p for f in lines if metres(*p, f[3], f[4]) <= 300] if i is not None else []
        best = min(near, key=order) if near else (None,) * 4
        return len({f for _, f, *_ in near}), round(best[0], 1) if near else None, best[2], best[3], bool(near)

    known = {0: want(0)} | {i: want(i) for i in places if i is None or i >= 1500}
    out = E.within_radius(df, features).select("listing_id", "n_features", "nearest_m", "kind", "voltage", "found")
    got = out.collect()
    assert len(got) == len(homes) and len({r.n_features for r in got}) > 5
    for r in got:
        assert tuple(r)[1:] == known[0 if r.listing_id is not None and r.listing_id < 1500 else r.listing_id], r
    assert 0 < max(rows_joined(out)) < 20_000


def test_updates_of_one_key_leave_one_row(spark):
    target = spark.createDataFrame([(1, None, ""), (2, 5, "b"), (None, 6, None)], "k long, n long, t string")
    updates = spark.createDataFrame([(1, 10, "old", 1), (1, 20, None, 3), (1, 15, "mid", 2), (2, 9, "z", None), (None, 1, "no", 9)], "k long, n long, t string, at long")
    rows = lambda df: sorted(map(tuple, df.select("k", "n", "t").collect()), key=str)
    assert rows(R.coalesce_update(target, updates, "k", ["n", "t"], order=("at",))) == [(1, 20, ""), (2, 5, "b"), (None, 6, None)]
    assert rows(R.coalesce_update(target, updates, "k", ["n", "t"], force=True, order=("at",))) == [(1, 20, None), (2, 9, "z"), (None, 6, None)]
    stamped = R.partial_enrich_update(target, updates, "k", ["n"], F.lit("now"), order=("at",))
    assert sorted(map(tuple, stamped.collect()), key=str) == [(1, 20, "", "now"), (2, 9, "b", "now"), (None, 6, None, None)]
    merged = R.first_non_null_merge(target, [updates, updates], "k", ["n", "t"], ["n"], order=("at",))
    assert merged.count() == 3
    agents = spark.createDataFrame([("a@x.com", "Zoe"), ("a@x.com", "Amy"), ("x.com", "Bo"), ("x.com", "Al")], "pattern string, agent string")
    mails = spark.createDataFrame([(1, "A@x.com"), (2, "<b@x.com>")], "id long, sender string")
    assert sorted((r.id, r.agent) for r in R.assign_agent(mails, agents).collect()) == [(1, "Amy"), (2, "Al")]


def test_two_responses_to_a_request_are_one_score(spark):
    requests = Views(spark, SF)("listings_v").filter("listing_id < 5").withColumns({"best_school": F.lit(50.0), "property_type": F.lit("house")})
    text = '{"score": 61, "verdict": "Worth Touring", "hard_results": [], "soft_points": {"a": "11"}, "concerns": [], "confidence": "high"}'
    responses = spark.createDataFrame([(1, text), (1, text.replace("61", "60")), (2, "not json")], "listing_id long, response string")
    valid, retry = C.apply_scores(requests, responses)
    assert [r.listing_id for r in valid.collect()] == [1]
    assert retry.count() == retry.distinct().count()


def in_ring(ring, y, x):
    odd = False
    for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_zones_of_any_size_have_few_cells_and_the_same_answers(spark):
    rng = random.Random(8)
    star = lambda y, x, r, n: [(y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n), x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    zones = {1: star(43, -75, 3, 60), 2: star(43, -75, 0.004, 5), 3: [(40, -80), (40, -70), (45, -70), (45, -80)], 4: star(-30, 10, 0.3, 9), 5: [(1.0, 1.0), (2.0, 2.0)], 6: star(0, 0, 20, 12)}
    points = [(rng.uniform(38, 47), rng.uniform(-81, -69)) for _ in range(300)] + [(43 + rng.uniform(-1, 1) * 0.005, -75 + rng.uniform(-1, 1) * 0.005) for _ in range(60)]
    points += [(-30 + rng.uniform(-1, 1) * 0.3, 10 + rng.uniform(-1, 1) * 0.3) for _ in range(60)] + [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(100)] + [(40.0, -75.0), (45.0, -75.0), (42.0, -80.0), (42.0, -70.0)]
    z = spark.createDataFrame([(i, "AE" if i % 2 else "X", [{"lat": float(a), "lng": float(b)} for a, b in r]) for i, r in zones.items()] + [(7, "X", None)], "zone_id long, zone string, ring array<struct<lat:double,lng:double>>")
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(9000, None, 1.0)], "listing_id long, lat double, lng double")
    got = {r.listing_id: r.zone_id for r in E.zone_lookup(df, z).collect()}
    assert got == {k: min((i for i, r in zones.items() if in_ring(r, *p)), default=None) for k, p in enumerate(points)} | {9000: None}
    assert len(set(got.values())) == 5
    cells = {r.zone_id: (r["n"], r.free) for r in E.zone_cover(z).groupBy("zone_id").agg(F.count("*").alias("n"), F.count_if(~F.col("border")).alias("free")).collect()}
    assert all(n < 4000 for n, _ in cells.values())
    assert all(cells[i][1] > 0 for i in (1, 3, 4, 6))
