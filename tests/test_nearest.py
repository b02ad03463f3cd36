"""The nearest station by descent through cubes, against all stations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from listingspark.functions import geo as G
from listingspark.operators import enrich as E

PLACE = "listing_id long, lat double, lng double"
STATION = "idx long, name string, lat double, lng double"


def against_all(points, stations):
    """Of every place and every station by the same formula, the nearest, the first on ties."""
    s = stations.filter("lat is not null and lng is not null").select("idx", "name", F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    d = G.haversine_m(F.col("lat"), F.col("lng"), F.col("slat"), F.col("slng"))
    best = points.join(s).groupBy("listing_id").agg(F.min(F.struct(d.alias("d"), "idx", "name")).alias("b"))
    return {r.listing_id: (r.name, r.m) for r in best.select("listing_id", "b.name", F.bround("b.d").cast("long").alias("m")).collect()}


def found(points, stations):
    return {r.listing_id: (r.station, r.station_m) for r in E.nearest_station(points, stations).collect()}


def uneven(seed):
    """Two dense towns, stations round the globe, at the poles and at the date line, and some twice at one place."""
    rng = random.Random(seed)
    at = [(40.7 + rng.random() / 50, -74.0 + rng.random() / 50) for _ in range(150)]
    at += [(51.5 + rng.random() / 500, rng.random() / 500) for _ in range(60)]
    at += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    at += [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.99), (10.0, -179.99)] + at[:10]
    rng.shuffle(at)
    return [(i, f"s{i}", y, x) for i, (y, x) in enumerate(at)] + [(900, "nowhere", None, 1.0), (901, "no number", float("nan"), 1.0)]


@pytest.mark.parametrize("most", [5_000, 20])
def test_every_place_gets_the_station_that_all_pairs_give(spark, monkeypatch, most):
    monkeypatch.setattr(E, "BROADCAST_STATIONS", most)
    rng = random.Random(most)
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(250)] + [(40.7 + rng.random() / 40, -74.0 + rng.random() / 40) for _ in range(100)]
    at += [(90.0, 0.0), (90.0, 120.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (10.0, 180.0), (10.0, -180.0), (89.9999, -180.0), (0.0, 0.0)]
    stations = spark.createDataFrame(uneven(4), STATION)
    at += [(r.lat, r.lng) for r in stations.filter("idx < 40").collect()]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], PLACE)
    real = stations.filter("not isnan(lat)")
    assert found(points, stations) == against_all(points, real)


def test_rows_without_a_place_and_tables_without_stations(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, 3.0, None), (3, float("nan"), 2.0), (4, 41.0, -73.0), (4, 41.0, -73.0)], PLACE)
    stations = spark.createDataFrame([(0, "A", 41.0, -73.0)], STATION)
    out = E.nearest_station(points, stations)
    assert sorted((r.listing_id, r.station, r.station_m) for r in out.collect()) == [(1, None, None), (2, None, None), (3, None, None), (4, "A", 0), (4, "A", 0)]
    assert {(r.station, r.walk_min) for r in E.nearest_station(points, stations.limit(0)).collect()} == {(None, None)}
    assert E.nearest_station(points.limit(0), stations).count() == 0


def test_a_tie_goes_to_the_first_station_of_the_table(spark):
    stations = spark.createDataFrame([(5, "late", 0.0, 1.0), (2, "west", 0.0, -1.0), (3, "east", 0.0, 1.0)], STATION)
    assert found(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.9)], PLACE), stations) == {1: ("west", 111195), 2: ("east", 11119)}


def test_remote_places_meet_few_stations(spark):
    """Places far from a town of many stations keep few cells: rows met, from the plan's own counts."""
    rng = random.Random(1)
    stations = spark.createDataFrame([(i, f"s{i}", 40.0 + rng.random(), -74.0 + rng.random()) for i in range(2000)], STATION)
    points = spark.createDataFrame([(i, -60.0 + 120 * rng.random(), 80 + 60 * rng.random()) for i in range(2000)], PLACE)
    out = E.nearest_station(points, stations)
    out.collect()
    joined = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(out._jdf.queryExecution().executedPlan())
    assert joined and max(joined) < 2000 * 2000 / 8
    assert found(points.filter("listing_id < 100"), stations) == against_all(points.filter("listing_id < 100"), stations)
    assert not math.isnan(out.agg(F.max("station_m")).head()[0])
