"""Enrichment by joins with reference tables, plain and spatial."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.functions import geo as G
from listingspark.functions import text as T
from listingspark.functions.markup import let

#: Cells or stations up to which joins by cell broadcast their table; a larger one is shuffled by cell.
BROADCAST_STATIONS = 5_000


def few(table: DataFrame, most: int = BROADCAST_STATIONS) -> DataFrame:
    """``table`` with a broadcast hint if it has ``most`` rows at most; else joins with it shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Distinct places or keys up to which what is known of them is broadcast to the rows; more are met by a shuffle.
BROADCAST_PLACES = 250_000

#: Stations that the fullest cell of the last level should hold at most, and levels at most; the last cells are 12 m wide.
LEAF_STATIONS, MOST_LEVELS = 16, 10
#: Cells at most that every place looks at in the first level taken; levels above it are passed over.
FIRST_CELLS = 16
#: Shares into which the places of a cell are dealt where cells are too many to broadcast.
SHARES = 64


def nearest_station(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds station, station_m and walk_min: the nearest station, the first in the table on ties.

    Places and stations are points on the unit sphere in space, where neither poles nor the
    date line differ from other places. Cubes, a quarter as wide from level to level, hold the
    stations. Each distinct place goes down from the whole sphere: of the cubes below those it
    has kept, it keeps those whose box of stations is no farther than the nearest of one
    station of each. So a place meets few stations, however remote it is and however unevenly
    stations lie. Cells are broadcast up to BROADCAST_STATIONS of a level; more are met by
    equi joins in shares, so that no cell makes a hot task. Rows without a place, or with one
    that is no number, get nulls, and so do all rows where there are no stations.
    """
    known = lambda y, x: F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(F.col(y).cast("double")) & ~F.isnan(F.col(x).cast("double"))
    table = stations.filter(known("lat", "lng")).groupBy(F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    table = table.agg(F.min(F.struct(F.col("idx").cast("long").alias("i"), "name")).alias("first")).select("slat", "slng", "first.i", "first.name")
    table = table.withColumns(dict(zip(("sx", "sy", "sz"), G.on_sphere(F.col("slat"), F.col("slng")), strict=True)))
    cube = lambda level: G.cube("sx", "sy", "sz", level)
    by_level = F.explode(F.array([F.struct(F.lit(k).alias("level"), cube(k).alias("cell")) for k in range(1, MOST_LEVELS + 1)]))
    held = table.select(by_level.alias("x")).groupBy("x.level", "x.cell").agg(F.count("*").alias("n"))
    levels = {r.level: r for r in held.groupBy("level").agg(F.max("n").alias("most"), F.count("*").alias("cells"), F.sum("n").alias("rows")).collect()}
    depth = next((k for k in sorted(levels) if levels[k].most <= LEAF_STATIONS), MOST_LEVELS if levels else 1)
    # level 0 is one cube; from there straight to the last level of few cells
    start = max((k for k in levels if k <= depth and levels[k].cells <= FIRST_CELLS), default=1)
    steps = list(zip([0, *range(start, depth)], range(start, depth + 1), strict=True))

    def meet(front: DataFrame, below: DataFrame, rows: int) -> DataFrame:
        if rows <= BROADCAST_STATIONS:
            return front.join(F.broadcast(below), "cell")
        front = front.withColumn("share", F.pmod(F.xxhash64("lat", "lng"), F.lit(SHARES)).cast("int"))
        return front.join(below.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["cell", "share"])

    axes = ("x", "y", "z")
    square = lambda gaps: sum((g * g for g in gaps), F.lit(0.0))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # places are few bytes and much work: no merging
    places = df.filter(known("lat", "lng")).select("lat", "lng").distinct().repartition(parts, "lat", "lng")
    front = places.select("lat", "lng", *[c.alias(k) for k, c in zip(axes, G.on_sphere(F.col("lat"), F.col("lng")), strict=True)], F.lit(0).cast("long").alias("cell"))
    for above, level in steps:
        box = [f(f"s{k}").alias(f"{name}_{k}") for k in axes for name, f in (("lo", F.min), ("hi", F.max))]
        one = F.first(F.struct("sx", "sy", "sz")).alias("one")
        below = table.groupBy(cube(above).alias("cell"), cube(level).alias("down")).agg(*box, one)
        met = meet(front, below, levels[level].cells if levels else 0)
        least = square(F.greatest(F.col(f"lo_{k}") - F.col(k), F.col(k) - F.col(f"hi_{k}"), F.lit(0.0)) for k in axes)
        sure = F.min(square(F.col(f"one.s{k}") - F.col(k) for k in axes)).over(Window.partitionBy("lat", "lng"))
        met = met.select("lat", "lng", *axes, F.col("down").alias("cell"), least.alias("least"), sure.alias("sure"))
        # rounding of distances must lose no tie
        front = met.filter(F.col("least") <= F.col("sure") * (1 + 1e-8) + 1e-24).drop("least", "sure")
    last = table.select(cube(depth).alias("cell"), "slat", "slng", "i", "name")
    met = meet(front, last, levels[depth].rows if levels else 0)
    away = G.haversine_m(F.col("lat"), F.col("lng"), F.col("slat"), F.col("slng"))
    state = met.groupBy("lat", "lng").agg(F.min(F.struct(away.alias("d"), F.col("i"), F.col("name"))).alias("__best"))
    # rows without a place would all have one key: each takes one of many that no place has
    spread = -1000.0 - F.pmod(F.xxhash64(*df.columns), F.lit(4099))
    rows = df.withColumns({"__lat": F.when(known("lat", "lng"), F.col("lat")).otherwise(spread), "__lng": F.when(known("lat", "lng"), F.col("lng")).otherwise(spread)})
    found = state.select(F.col("lat").alias("__lat"), F.col("lng").alias("__lng"), "__best")
    out = rows.join(found, ["__lat", "__lng"], "left")
    metres = F.bround(F.col("__best.d"))
    return out.select(*df.columns, F.col("__best.name").alias("station"), metres.cast("long").alias("station_m"), F.bround(F.col("__best.d") / 83).cast("long").alias("walk_min"))


#: Latitude beyond which meridians stand so close that rows and vertices meet by latitude alone.
POLAR = 85.0


def _shapes(vertices: DataFrame) -> DataFrame:
    """(shape, n, vlat, vlng): the vertices of each distinct set of them, told by the least feature_id of the n features that have it.

    Sets are told apart by their sizes and two hashes. Vertices without a feature_id are one feature.
    """
    points = vertices.select("feature_id", "vlat", "vlng").distinct()
    named = points.filter("feature_id is not null")
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "vlat", "vlng")).alias(f"h{k}") for k in (1, 2)]
    sets = named.groupBy("feature_id").agg(*digests, F.count("*").alias("size"))
    chosen = sets.groupBy("h1", "h2", "size").agg(F.min("feature_id").alias("feature_id"), F.count("*").alias("n"))
    rows = named.join(chosen.select("feature_id", "n"), "feature_id").unionByName(points.filter("feature_id is null").withColumn("n", F.lit(1).cast("long")))
    return rows.withColumnRenamed("feature_id", "shape")


def _meetings(places: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """(lat, lng, shape, n, x): for distinct places the ``_shapes`` with a vertex within the radius, x the nearest vertex.

    Places and vertices meet in grid cells, an equi join with the distance as residual
    test. Cells go round the globe, so 180 and -180 degrees are one; near a pole a place meets all
    vertices of its latitudes.
    """
    degrees = radius_m / 111_000
    reach = max(1, int(degrees / G.CELL) + 1)
    around = round(360 / G.CELL)
    polar = lambda y: F.abs(y) + degrees > POLAR
    # a degree of longitude is shorter; so its cells reach further, but never beyond the globe
    span = F.least(F.ceil(F.lit(degrees) / F.cos(F.radians(F.abs("lat") + degrees)) / G.CELL), F.lit(around // 2)).cast("long")
    columns = F.array_distinct(F.transform(F.sequence(G.cell(F.col("lng")) - span, G.cell(F.col("lng")) + span), lambda c: F.pmod(c, F.lit(around))))
    near = places.withColumn("cx", F.explode(F.when(polar(F.col("lat")), F.array(F.lit(-1).cast("long"))).otherwise(columns)))
    near = near.withColumn("cy", F.explode(G.neighbours(G.cell(F.col("lat")), reach)))
    vertices = features.select("feature_id", "kind", "voltage", F.col("lat").alias("vlat"), F.col("lng").alias("vlng")).filter(_on_globe("vlat", "vlng"))
    # features of one shape are one here, and of all at a vertex only the first may be the nearest
    first = vertices.groupBy("vlat", "vlng").agg(F.min(F.struct("feature_id", "kind", "voltage")).alias("first"))
    own = F.pmod(G.cell(F.col("vlng")), F.lit(around))
    # those that a polar row may reach are listed by latitude as well
    listed = F.when(F.abs("vlat") + 3 * degrees > POLAR, F.array(own, F.lit(-1).cast("long"))).otherwise(F.array(own))
    met = _shapes(vertices).join(first, ["vlat", "vlng"]).select("*", G.cell(F.col("vlat")).alias("cy"), F.explode(listed).alias("cx"))
    hits = near.join(met, ["cy", "cx"]).withColumn("d", G.haversine_m(F.col("lat"), F.col("lng"), F.col("vlat"), F.col("vlng"))).filter(F.col("d") <= radius_m)
    return hits.groupBy("lat", "lng", "shape").agg(F.max("n").alias("n"), F.min(F.struct("d", "first.feature_id", "first.kind", "first.voltage")).alias("x"))


def _on_globe(lat: str, lng: str) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lng) <= 360)


def _summed(meetings: DataFrame, *by: str) -> DataFrame:
    """(by, n_features, nearest_m, kind, voltage) of meetings, of which each shape has one with ``by``."""
    out = meetings.groupBy(*by).agg(F.sum("n").alias("n_features"), F.min("x").alias("x"))
    return out.select(*by, "n_features", F.round("x.d", 1).alias("nearest_m"), F.col("x.kind").alias("kind"), F.col("x.voltage").alias("voltage"))


def places_within_radius(df: DataFrame, features: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """(lat, lng, n_features, nearest_m, kind, voltage): each distinct place of ``df`` that has a feature within the radius."""
    return _summed(_meetings(df.filter(_on_globe("lat", "lng")).select("lat", "lng").distinct(), features, radius_m), "lat", "lng")


def within_radius(df: DataFrame, features: DataFrame, radius_m: float = 300.0, key: str = "listing_id") -> DataFrame:
    """(key, n_features, nearest_m, kind, voltage, found): features with a vertex within the radius.

    Distinct places meet distinct sets of vertices, so neither rows at one place nor features at
    the same vertices multiply. Features count once, however many vertices they have. Distances
    are to vertices, not to the lines between them. Rows of one key count together. Rows without a
    feature get found = false, and so do those whose place is no place on the globe.
    """
    usable = df.select(key, "lat", "lng").filter(_on_globe("lat", "lng"))
    met = _meetings(usable.select("lat", "lng").distinct(), features, radius_m)
    ends = usable.groupBy(key).agg(*[f(c).alias(f"{name}_{c}") for c in ("lat", "lng") for name, f in (("lo", F.min), ("hi", F.max))])
    one = (F.col("lo_lat") == F.col("hi_lat")) & (F.col("lo_lng") == F.col("hi_lng"))
    single = ends.filter(one).select(key, F.col("lo_lat").alias("lat"), F.col("lo_lng").alias("lng"))
    out = single.join(_summed(met, "lat", "lng"), ["lat", "lng"]).drop("lat", "lng")
    # a key with several places has what any of them has
    several = usable.join(ends.filter(~one).select(key), key).distinct().join(met, ["lat", "lng"])
    out = out.unionByName(_summed(several.groupBy(key, "shape").agg(F.max("n").alias("n"), F.min("x").alias("x")), key))
    return df.select(key).join(out, key, "left").withColumns({"found": F.col("n_features").isNotNull(), "n_features": F.coalesce("n_features", F.lit(0).cast("long"))})


def _inside(ring: Column, y: Column, x: Column) -> Column:
    """Whether a ray from the point crosses the ring's sides an odd number of times."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = lambda a, b: ((a["lat"] > y) != (b["lat"] > y)) & (
        x < (b["lng"] - a["lng"]) * (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lng"]
    )
    return F.aggregate(F.zip_with(ring, shifted, crosses), F.lit(0), lambda acc, c: acc + F.coalesce(c, F.lit(False)).cast("int")) % 2 == 1


#: A polygon's span is cut in 2 to this power, and cells that a side meets once more.
COVER_CUTS = 3
#: Corners of all polygons together up to which their rings are broadcast.
BROADCAST_CORNERS = 200_000


def _levels(size: float) -> tuple[Column, Column]:
    """The levels of a ring's coarse and fine cells; cells have ``size`` degrees at level 0 and double from level to level."""
    ys, xs = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lng"])
    wide = F.greatest(F.array_max(ys) - F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.lit(size))
    top = F.ceil(F.log2(wide / size)).cast("int")
    return F.greatest(top - COVER_CUTS, F.lit(0)), F.greatest(top - 2 * COVER_CUTS, F.lit(0))


def _coarser(cell: Column, level: Column) -> Column:
    """The cell of a level that holds a cell of level 0."""
    return F.call_function("shiftright", cell, level)


def zone_cover(zones: DataFrame, size: float = 0.01) -> DataFrame:
    """(zone_id, level, cy, cx, border): the cells that cover each polygon (zone_id, ring).

    A polygon's span has some nine by nine coarse cells, whatever its size. Those that no side
    meets are wholly inside, or are left out; the others are cut into eight by eight fine ones,
    likewise told apart, with only the sides that the coarse cell meets. So there are some
    thousand cells a polygon at most, of which border cells follow its sides.
    """
    coarse, fine = _levels(size)
    after = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    sides = F.zip_with("ring", after, lambda a, b: F.struct(a["lat"].alias("ay"), a["lng"].alias("ax"), b["lat"].alias("by"), b["lng"].alias("bx")))
    shaped = zones.filter(F.size("ring") > 2).select("zone_id", "ring", coarse.alias("level"), fine.alias("fine"), sides.alias("sides"))

    def span(c: str) -> Column:
        ends = [_coarser(G.cell(f(F.transform("ring", lambda p: p[c])), size), F.col("level")) for f in (F.array_min, F.array_max)]
        return F.explode(F.sequence(*ends))

    def met(df: DataFrame) -> DataFrame:
        """Keeps the sides that touch a row's cell, or come within a rounding error of it."""
        w = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
        ends = {f"__{c}{k}": (F.col(c) + k) * w + (2e-9 * k - 1e-9) for c in ("cy", "cx") for k in (0, 1)}
        y0, y1, x0, x1 = (F.col(c) for c in ends)

        def touches(s: Column) -> Column:
            box = (F.greatest(s["ay"], s["by"]) >= y0) & (F.least(s["ay"], s["by"]) <= y1) & (F.greatest(s["ax"], s["bx"]) >= x0) & (F.least(s["ax"], s["bx"]) <= x1)
            corners = F.array(*[(s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]) for y in (y0, y1) for x in (x0, x1)])
            return box & let(corners, lambda c: (F.array_min(c) <= 0) & (F.array_max(c) >= 0))

        return df.withColumns(ends).withColumn("sides", F.filter("sides", touches)).drop(*ends)

    first = met(shaped.withColumn("cy", span("lat")).withColumn("cx", span("lng")))
    cut = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("level") - F.col("fine")) - 1)
    deeper = lambda c, k: F.call_function("shiftleft", F.col(c), F.col("level") - F.col("fine")) + F.col(k)
    small = first.filter(F.size("sides") > 0).withColumn("y", F.explode(cut)).withColumn("x", F.explode(cut))
    small = met(small.withColumns({"cy": deeper("cy", "y"), "cx": deeper("cx", "x"), "level": F.col("fine")}).drop("y", "x"))
    cells = first.filter(F.size("sides") == 0).unionByName(small)
    middle = lambda c: (F.col(c) + 0.5) * size * F.pow(F.lit(2.0), F.col("level"))
    border = F.size("sides") > 0
    return cells.filter(border | _inside(F.col("ring"), middle("cy"), middle("cx"))).select("zone_id", "level", "cy", "cx", border.alias("border"))


def zone_lookup(df: DataFrame, zones: DataFrame, key: str = "listing_id", size: float = 0.01) -> DataFrame:
    """(key, zone_id, zone, sfha): the zone polygon that holds the point, the smallest id of several.

    Polygons (zone_id, zone, ring: array of lat, lng), one row a zone, are met by the cells of
    ``zone_cover``, a point's own at every level: a cell wholly inside answers by itself, and
    only points in border cells are tested by a ray.
    """
    coarse, fine = _levels(size)
    facts = zones.filter(F.size("ring") > 2).agg(F.min(fine).alias("lo"), F.max(coarse).alias("hi"), F.sum(F.size("ring")).alias("corners")).head()
    points = df.filter("lat is not null and lng is not null").select(key, "lat", "lng")
    levels = F.explode(F.sequence(F.lit(facts.lo or 0), F.lit(facts.hi or 0))).alias("level")
    own = points.select(key, "lat", "lng", levels).withColumns({c: _coarser(G.cell(F.col(x), size), F.col("level")) for c, x in (("cy", "lat"), ("cx", "lng"))})
    met = own.join(zone_cover(zones, size), ["level", "cy", "cx"])
    rings = zones.select("zone_id", "ring")
    rings = F.broadcast(rings) if (facts.corners or 0) <= BROADCAST_CORNERS else rings
    tested = met.filter("border").join(rings, "zone_id").filter(_inside(F.col("ring"), F.col("lat"), F.col("lng")))
    inside = met.filter("not border").select(key, "zone_id").union(tested.select(key, "zone_id"))
    best = inside.groupBy(key).agg(F.min("zone_id").alias("zone_id"))
    named = few(zones.select("zone_id", "zone"))
    return df.select(key).join(best, key, "left").join(named, "zone_id", "left").select(key, "zone_id", "zone").withColumn("sfha", F.upper("zone").rlike("^[AV]"))


# States without parcels here, and street names written as one word or two.
NO_PARCEL_STATES = ("NJ", "CT", "PA", "MA")
STREET_COMPOUNDS = (
    ("LAKESHORE", "LAKE SHORE"), ("LAKESIDE", "LAKE SIDE"), ("LAKEVIEW", "LAKE VIEW"), ("BROOKSIDE", "BROOK SIDE"),
    ("HILLSIDE", "HILL SIDE"), ("HILLCREST", "HILL CREST"), ("RIDGEWOOD", "RIDGE WOOD"), ("RIDGEWAY", "RIDGE WAY"),
    ("WOODSIDE", "WOOD SIDE"), ("CLIFFSIDE", "CLIFF SIDE"), ("PARKWAY", "PARK WAY"),
)
BOROUGHS = {"manhattan": "1", "bronx": "2", "brooklyn": "3", "queens": "4", "staten island": "5"}
#: Leading letters that an equi join on a street's beginning goes by.
PREFIX = 3


def _house(address: Column) -> tuple[Column, Column]:
    """The first word of an address, and the rest in upper case; null without a rest."""
    parts = F.split(F.trim(address), r"\s+", 2)
    return F.get(parts, F.lit(0)), F.upper(F.trim(F.get(parts, F.lit(1))))


def _word(c: Column, n: int = 1) -> Column:
    return F.substring_index(F.regexp_replace(c, r"\s+", " "), " ", n)


def _by_prefix(left: DataFrame, right: DataFrame, keys: list[str], begin: str, whole: str) -> DataFrame:
    """Rows of both that share ``keys`` and whose ``whole`` (right) starts with ``begin`` (left).

    An equi join on the keys and up to PREFIX leading letters, with the rest as residual test.
    """
    size = F.least(F.length(begin), F.lit(PREFIX))
    a = left.withColumns({"__n": size, "__p": F.left(F.col(begin), size)})
    b = right.withColumn("__n", F.explode(F.sequence(F.lit(1), F.least(F.length(whole), F.lit(PREFIX))))).withColumn("__p", F.left(F.col(whole), F.col("__n")))
    return a.join(b.filter(F.length(whole) > 0), [*keys, "__n", "__p"]).filter(F.col(whole).startswith(F.col(begin))).drop("__n", "__p")


def county_of(df: DataFrame, town_county: DataFrame, default: str = "Westchester") -> DataFrame:
    """Adds county: that of the town in ``town_county``, null where that says so, else ``default``."""
    towns = town_county.groupBy(F.lower(F.trim("town")).alias("__town")).agg(F.min("county").alias("__county"), F.lit(True).alias("__listed"))
    out = df.join(few(towns), F.lower(F.trim("town")) == F.col("__town"), "left")
    return out.withColumn("county", F.when(F.col("__listed"), F.col("__county")).otherwise(default)).drop("__town", "__county", "__listed")


def parcel_lot_acres(df: DataFrame, parcels: DataFrame, town_county: DataFrame) -> DataFrame:
    """(listing_id, lot_acres): the lot of the best parcel of the same county, number and street.

    Candidates' streets begin with the street's first word, or where there is none, with the
    first word of its compound written apart. House number and two words of the street rank
    before the municipality, that before the city, where names that contain each other agree
    and a blank one agrees with all; a sole candidate is taken for want of better. The first
    of the best with acres, else calculated ones, above zero counts.
    """
    number, street = _house(F.col("address"))
    rows = df.filter(~F.coalesce(F.left(F.upper(F.trim("state")), F.lit(2)).isin(*NO_PARCEL_STATES), F.lit(False)))
    rows = county_of(rows.select("listing_id", "address", "town"), town_county)
    rows = rows.select("listing_id", F.upper(F.trim(F.coalesce("town", F.lit("")))).alias("town"), "county", number.alias("number"), street.alias("street"))
    rows = rows.filter("county is not null and number <> '' and street <> ''")
    keys = ["county", "town", "number", "street"]
    places = rows.select(*keys).distinct()
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    p = parcels.select("parcel_id", "county", "number", upper(F.col("street")).alias("pstreet"), upper(F.col("municipality")).alias("muni"), upper(F.col("city_town")).alias("city"), "acres", "calc_acres")
    lot = F.when(F.col("acres") > 0, F.col("acres")).when(F.col("calc_acres") > 0, F.col("calc_acres"))
    # parcels that any place would rank alike are one candidate: the first of them with a lot
    p = p.withColumn("lot", lot).groupBy("county", "number", _word(F.col("pstreet"), 2).alias("ptwo"), "muni", "city")
    p = p.agg(F.min("parcel_id").alias("lo"), F.max("parcel_id").alias("hi"), F.min(F.when(F.col("lot").isNotNull(), F.struct("parcel_id", "lot"))).alias("p"))
    # the compounds are a fixed list: every place has its own word first, then those that apply
    compound = [F.when(F.col("street").startswith(a), F.struct(F.lit(k + 1).alias("turn"), F.lit(b.split()[0]).alias("word"))) for k, (a, b) in enumerate(STREET_COMPOUNDS)]
    turns = F.array_compact(F.array(F.struct(F.lit(0).alias("turn"), _word(F.col("street")).alias("word")), *compound))
    met = _by_prefix(places.select(*keys, F.explode(turns).alias("t")).select(*keys, "t.*"), p, ["county", "number"], "word", "ptwo")
    two = _word(F.col("street"), 2)
    either = lambda a: F.col(a).contains(F.col("town")) | F.col("town").contains(F.col(a))
    rank = F.when((two == F.col("ptwo")) & two.contains(" "), 3).when(either("muni"), 2).when(either("city"), 1).otherwise(0)
    ranked = met.groupBy(*keys, "turn").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("p").isNotNull() & (rank > 0), F.struct((-rank).alias("r"), "p"))).alias("good"), F.min("p").alias("any"))
    # the first turn that finds parcels at all
    best = ranked.groupBy(*keys).agg(F.min(F.struct("turn", "lo", "hi", "good", "any")).alias("b"))
    found = F.coalesce("b.good.p.lot", F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.any.lot")))
    return rows.join(best, keys).select("listing_id", F.round(found, 4).alias("lot_acres")).filter("lot_acres is not null")


def property_tax(df: DataFrame, rolls: DataFrame, town_county: DataFrame, nyc: DataFrame, municipalities: DataFrame) -> DataFrame:
    """(listing_id, assessed, market, tier): city roll, else municipality's, else the county's.

    ``nyc``: (row_id, boro, address, assessed, market), met by borough and the address as a
    beginning. ``rolls``: (parcel_id, county, municipality, number, street, assessed, market),
    met by number and the street's first word as a beginning, in the municipality that
    ``municipalities`` (town, municipality) names for the town, the town itself else, and
    then in the town's county. The first row of a tier counts; its zeros are unknown. Rows
    without a town, or with one word for an address, have no tax.
    """
    number, street = _house(F.col("address"))
    rows = df.filter(~T.blank(F.col("address")) & ~T.blank(F.col("town"))).select("listing_id", F.trim("town").alias("town"), F.upper(F.trim("address")).alias("address"), number.alias("number"), _word(street).alias("word")).filter("word <> ''")
    # places, not rows, meet the rolls, and a place has one row of each tier
    borough = F.coalesce(F.create_map(*[F.lit(x) for kv in BOROUGHS.items() for x in kv])[F.lower("town")], F.lower("town"))
    city = rows.select(borough.alias("boro"), "address").distinct().filter("boro <> ''")
    roll = nyc.select("row_id", "boro", F.upper("address").alias("whole"), "assessed", "market")
    number_of = lambda c: _word(F.col(c))
    city = _by_prefix(city.withColumn("nr", number_of("address")), roll.withColumn("nr", number_of("whole")), ["boro", "nr"], "address", "whole")
    city = city.groupBy("boro", "address").agg(F.min(F.struct("row_id", "assessed", "market")).alias("c"))
    named = few(municipalities.groupBy(F.lower("town").alias("__t")).agg(F.min("municipality").alias("__m")))
    rows = county_of(rows.withColumn("boro", borough), town_county).join(named, F.lower("town") == F.col("__t"), "left")
    rows = rows.withColumn("muni", F.upper(F.coalesce("__m", "town"))).drop("__t", "__m")
    state = rolls.select("parcel_id", "county", F.upper("municipality").alias("muni"), "number", _word(F.upper("street")).alias("whole"), "assessed", "market")

    def tier(key: str, label: str) -> DataFrame:
        first = state.groupBy(key, "number", "whole").agg(F.min(F.struct("parcel_id", "assessed", "market")).alias("x"))
        places = rows.select(key, "number", "word").distinct().filter(f"{key} <> '' and word <> ''")
        return _by_prefix(places, first, [key, "number"], "word", "whole").groupBy(key, "number", "word").agg(F.min("x").alias(label))

    out = rows.join(city, ["boro", "address"], "left").join(tier("muni", "m"), ["muni", "number", "word"], "left").join(tier("county", "w"), ["county", "number", "word"], "left")
    best = lambda n: F.when(F.col("c").isNotNull(), F.col(f"c.{n}")).when(F.col("m").isNotNull(), F.col(f"m.{n}")).otherwise(F.col(f"w.{n}"))
    label = F.when(F.col("c").isNotNull(), "city").when(F.col("m").isNotNull(), "municipality").when(F.col("w").isNotNull(), "county")
    out = out.select("listing_id", *[F.nullif(best(n), F.lit(0)).alias(n) for n in ("assessed", "market")], label.alias("tier"))
    return out.filter("tier is not null")


LEVELS = (("elem", "elementary"), ("mid", "middle"), ("high", "high"))


def schools_by_zip(df: DataFrame, schools: DataFrame, k: int = 3) -> DataFrame:
    """(listing_id, level, names, best): the ``k`` best schools of each level in the listing's zip."""
    s = F.lower("level")
    level = F.when(s.contains("elem"), "elementary").when(s.contains("mid"), "middle").when(s.contains("high"), "high")
    ranked = schools.withColumn("kind", level).filter("kind is not null")
    rn = F.row_number().over(Window.partitionBy("zip", "kind").orderBy(F.coalesce("percentile", F.lit(0.0)).desc(), "school_id"))
    top = ranked.withColumn("rn", rn).filter(F.col("rn") <= k)
    top = top.groupBy("zip", "kind").agg(F.array_sort(F.collect_list(F.struct("rn", "name", "percentile"))).alias("x"))
    out = df.join(top, F.col("zip_code") == F.col("zip"))
    return out.select("listing_id", F.col("kind").alias("level"), F.array_join("x.name", ",").alias("names"), F.array_max("x.percentile").alias("best"))


def best_elementary(schools: Column) -> Column:
    """Greatest numeric percentile of an array of schools, null if there is none."""
    return F.array_max(F.transform(schools, lambda x: x["percentile"].cast("string").try_cast("double")))


def read_wide_index(wide: DataFrame, months: list[str]) -> DataFrame:
    """(zip, value): the last month's value, by position, of a wide monthly table of zips; blanks are dropped."""
    return wide.filter("region_type = 'zip'").select(F.lpad("zip", 5, "0").alias("zip"), F.col(months[-1]).try_cast("double").alias("value")).filter("value is not null")


def price_signal(price: Column, sqft: Column, value: Column) -> Column:
    """struct(ppsf, benchmark, ratio, signal); null without price, size or index."""
    ppsf, bench = price / sqft, value / 1500
    ratio = ppsf / bench
    signal = F.when(ratio < 0.85, "below_market").when(ratio > 1.20, "above_market").otherwise("at_market")
    out = F.struct(F.bround(ppsf, 2).alias("ppsf"), F.bround(bench, 2).alias("benchmark"), F.bround(ratio, 3).alias("ratio"), signal.alias("signal"))
    return F.when(price.isNotNull() & (sqft > 0) & (value > 0), out)


def price_per_sqft_signal(df: DataFrame, index: DataFrame) -> DataFrame:
    out = df.join(index, F.col("zip_code") == F.col("zip"), "left").withColumn("__p", price_signal(F.col("price"), F.col("sqft"), F.col("value")))
    return out.select("listing_id", "__p.*")


def commute(df: DataFrame, stations: DataFrame, overrides: DataFrame, drives: DataFrame, transits: DataFrame) -> DataFrame:
    """(listing_id, station, minutes, rejected): drive to the town's station, then transit from there.

    ``overrides`` (town, station_town) names another town's station for some towns, and
    ``stations`` (idx, name, lat, lng) are met by their folded names. ``drives`` (listing_id,
    station, drive_s, road_m) and ``transits`` (station, transit_s) are the legs of routes; of
    several legs between the same ends the shortest above zero counts. Null with a reason where
    the station is unknown, a leg is missing or too long, or its road winds too much against the
    straight line. One row for each row of ``df``.
    """
    other = few(overrides.groupBy(F.lower("town").alias("__town")).agg(F.min("station_town").alias("__other")))
    ways = transits.filter("transit_s > 0").groupBy(F.col("station").alias("name")).agg(F.min("transit_s").alias("transit_s"))
    named = stations.groupBy(T.fold_place(F.col("name")).alias("__key")).agg(F.min(F.struct("idx", "name", "lat", "lng")).alias("__s"))
    named = few(named.withColumn("name", F.col("__s.name")).join(ways, "name", "left").drop("name"))
    legs = drives.filter("drive_s > 0").groupBy("listing_id", "station").agg(F.min(F.struct("drive_s", "road_m")).alias("__d"))
    out = df.select("listing_id", "town", "lat", "lng").join(other, F.lower("town") == F.col("__town"), "left")
    out = out.withColumn("__key", T.fold_place(F.coalesce("__other", "town"))).join(named, "__key", "left").withColumn("station", F.col("__s.name"))
    out = out.join(legs, ["listing_id", "station"], "left").withColumns({"drive_s": F.col("__d.drive_s"), "road_m": F.col("__d.road_m")})
    straight = G.haversine_m(F.col("lat"), F.col("lng"), F.col("__s.lat"), F.col("__s.lng"))
    reason = (
        F.when(F.col("station").isNull(), "no_station")
        .when(F.col("drive_s").isNull() | F.col("transit_s").isNull(), "missing_leg")
        .when(F.col("transit_s") > 120 * 60, "transit_too_long")
        .when(F.col("drive_s") > 30 * 60, "drive_too_long")
        .when(F.col("road_m") > F.greatest(3 * straight, F.lit(5000)), "road_too_long")
    )
    minutes = F.bround((F.col("drive_s") + F.col("transit_s")) / 60).cast("long")
    return out.select("listing_id", "station", F.when(reason.isNull(), minutes).alias("minutes"), reason.alias("rejected"))


def departure_slot(ts: Column) -> Column:
    """Eight o'clock in New York on the next weekday, as a UTC instant."""
    day = F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
    step = F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1)
    local = F.to_timestamp(F.concat(F.date_add(day, step).cast("string"), F.lit(" 08:00:00")))
    return F.to_utc_timestamp(local, "America/New_York")


def invalidate_commutes(df: DataFrame, max_drive: int = 30) -> DataFrame:
    """Drops commutes that drive too long; tells where the nearest station is not the one used."""
    long = F.coalesce(F.col("drive_minutes") > max_drive, F.lit(False))
    other = ~F.coalesce(F.col("used_station").contains(F.col("station")), F.lit(True))
    return df.select("listing_id", F.when(~long, F.col("commute_minutes")).alias("commute_minutes"), long.alias("condemned"), other.alias("other_station"))


def clear_stale_commutes(df: DataFrame, towns: list[str], max_minutes: int = 150) -> DataFrame:
    stale = (F.coalesce(F.col("commute_mode"), F.lit("")) == "transit") | F.coalesce(F.col("commute_minutes") > max_minutes, F.lit(False)) | F.col("town").isin(*towns)
    return df.withColumn("commute_minutes", F.when(~stale, F.col("commute_minutes")))


def clear_bogus_schools(df: DataFrame, schools: str = "schools") -> DataFrame:
    return df.withColumn(schools, F.when(~F.exists(schools, lambda x: F.coalesce(x["name"].startswith("School #"), F.lit(False))), F.col(schools)))


def resolve_urls(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Fills missing URLs by address and town, by town's first candidate of the address else; absolute."""
    key = lambda a, t: F.concat_ws("|", F.lower(F.trim(a)), F.lower(F.trim(t)))
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit("https://www.redfin.com"), F.col("url"))).otherwise(F.col("url"))
    ref = reference.groupBy(key(F.col("address"), F.col("town")).alias("__key")).agg(F.min(url).alias("__url"))
    out = df.join(few(ref, BROADCAST_PLACES), key(F.col("address"), F.col("town")) == F.col("__key"), "left")
    return out.withColumn("listing_url", F.coalesce(F.nullif("listing_url", F.lit("")), "__url")).select(*df.columns)


def geocode_join(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Fills missing coordinates from a table by the lower-cased address, town and state."""
    parts = lambda: F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("address", "town", "state")])
    ref = reference.groupBy(parts().alias("__key")).agg(F.min(F.struct("lat", "lng")).alias("g"))
    out = df.join(few(ref, BROADCAST_PLACES), parts() == F.col("__key"), "left")
    return out.withColumns({"lat": F.coalesce("lat", "g.lat"), "lng": F.coalesce("lng", "g.lng")}).select(*df.columns)


def fix_sentinel_lot(df: DataFrame, bad: float = 4.0) -> DataFrame:
    """(listing_id, old, new) of lots at a sentinel value: read anew from the text, or null."""
    again = T.parse_lot_acres(F.col("description"))
    return df.filter(F.col("lot_acres") == bad).select("listing_id", F.col("lot_acres").alias("old"), F.when(again != bad, again).alias("new"))


@dataclass(frozen=True)
class References:
    """The reference tables of ``enrich_all``, each as its own operator takes it."""

    stations: DataFrame
    index: DataFrame
    features: DataFrame
    zones: DataFrame
    parcels: DataFrame
    rolls: DataFrame
    nyc: DataFrame
    municipalities: DataFrame
    town_county: DataFrame
    schools: DataFrame
    overrides: DataFrame
    drives: DataFrame
    transits: DataFrame
    places: DataFrame
    urls: DataFrame


#: The columns that tell one place from another.
PLACE = ("address", "town", "state", "zip_code", "lat", "lng")


@dataclass(frozen=True)
class Lookup:
    """A lookup of ``enrich_all``: what it needs, what it fills, and how it finds it for places.

    A row is asked about if it has all of ``needs``, lacks one of ``core`` and bears no
    marker. ``find`` takes the places asked about, keyed by listing_id, and returns the columns of
    ``fills`` for those of which something is known; they are put in together. What it finds
    depends on the columns ``by`` of a place alone.
    """

    name: str
    needs: tuple[str, ...]
    core: tuple[str, ...]
    fills: tuple[str, ...]
    find: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...] = PLACE

    def asked(self, columns: list[str]) -> Column:
        lacks = F.lit(False)
        for c in self.core:
            lacks = lacks | (F.col(c).isNull() if c in columns else F.lit(True))
        fit = lacks
        for c in self.needs:
            fit = fit & F.col(c).isNotNull()
        marker = f"{self.name}_checked"
        return fit & ~F.coalesce(F.col(marker), F.lit(False)) if marker in columns else fit


def lookups(refs: References) -> list[Lookup]:
    """Those that depend on a row's place alone."""
    point, address = ("lat", "lng"), ("address", "town")

    def power(places: DataFrame) -> DataFrame:
        return places.join(places_within_radius(places, refs.features), list(point)).select("listing_id", "n_features", "nearest_m")

    def schools(places: DataFrame) -> DataFrame:
        by_level = schools_by_zip(places, refs.schools).select("listing_id", F.struct("level", "names", "best").alias("x"))
        return by_level.groupBy("listing_id").agg(F.array_sort(F.collect_list("x")).alias("schools"))  # three levels at most

    def lot(places: DataFrame) -> DataFrame:
        return parcel_lot_acres(places, refs.parcels, refs.town_county).filter("lot_acres between 0.01 and 1000")

    near = ("station", "station_m", "walk_min")
    house = (*address, "state")
    return [
        Lookup("station", point, near, near, lambda p: nearest_station(p.select("listing_id", *point), refs.stations).drop(*point).filter("station is not null"), point),
        Lookup("power", point, ("n_features",), ("n_features", "nearest_m"), power, point),
        Lookup("zone", point, ("zone",), ("zone", "sfha"), lambda p: zone_lookup(p, refs.zones).filter("zone is not null").select("listing_id", "zone", "sfha"), point),
        Lookup("tax", address, ("tier",), ("assessed", "market", "tier"), lambda p: property_tax(p, refs.rolls, refs.town_county, refs.nyc, refs.municipalities), house),
        Lookup("schools", ("zip_code",), ("schools",), ("schools",), schools, ("zip_code",)),
        Lookup("lot", ("address",), ("lot_acres",), ("lot_acres",), lot, house),
    ]


def _place_key(by: tuple[str, ...] = PLACE) -> Column:
    """Two hashes of a place; nulls count, so that a value in another column is another place."""
    parts = [x for c in by for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def place_answers(base: DataFrame, wanted: list[Lookup], by: tuple[str, ...] = PLACE) -> DataFrame:
    """(__place, <name> as a struct of what it fills) for the distinct places of ``base`` that are asked about, told apart by ``by``.

    Every lookup gets the places with its bit set, from one shared aggregation, and what all find
    becomes one table, which is broadcast if BROADCAST_PLACES places at most are asked about.
    """
    bits = F.lit(0)
    for k, lookup in enumerate(wanted):
        bits = bits.bitwiseOR(F.when(F.coalesce(lookup.asked(base.columns), F.lit(False)), 1 << k).otherwise(0))
    rows = base.select(*by, bits.alias("__bits")).filter("__bits > 0")
    # Spark keeps the filters of single lookups above such a number, so all read one shuffle of the places
    places = rows.groupBy(*by).agg(F.bit_or("__bits").alias("__bits")).withColumn("__nr", F.monotonically_increasing_id()).filter("__nr >= 0")
    places = places.withColumn("listing_id", _place_key(by))
    found = None
    for k, lookup in enumerate(wanted):
        answer = lookup.find(places.filter(F.col("__bits").bitwiseAND(F.lit(1 << k)) > 0).select("listing_id", *by))
        answer = answer.select(F.col("listing_id").alias("__place"), F.struct(*lookup.fills).alias(f"__{lookup.name}"))
        found = answer if found is None else found.unionByName(answer, allowMissingColumns=True)
    answers = found.groupBy("__place").agg(*[F.first(f"__{x.name}", ignorenulls=True).alias(f"__{x.name}") for x in wanted])
    return F.broadcast(answers) if rows.select(*by).distinct().limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES else answers


def _fills(lookup: Lookup, columns: list[str], kinds: dict) -> dict[str, Column]:
    """The columns that a lookup fills from the struct __<name> where it was asked, and its marker where that is null.

    ``columns`` are those of the table as it came, ``kinds`` the types of the struct's fields.
    """
    found, marker = F.col(f"__{lookup.name}"), f"{lookup.name}_checked"
    ask = F.coalesce(lookup.asked(columns), F.lit(False))
    old = lambda c, kind: F.col(c) if c in columns else F.lit(None).cast(kind)
    given = {c: F.when(ask & found.isNotNull(), found[c]).otherwise(old(c, kinds[c])) for c in lookup.fills}
    return given | {marker: (ask & found.isNull()) | F.coalesce(old(marker, "boolean"), F.lit(False))}


def _read_description(df: DataFrame) -> dict[str, Column]:
    """What a description tells: dues and size source are read anew, the rest fills gaps; pairs go together."""
    from listingspark.functions import features as X

    d, have = F.col("description"), set(df.columns)
    old = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    out = {"hoa_monthly": F.coalesce(X.hoa(d)["hoa_monthly"], old("hoa_monthly", "long"))}
    source = X.sqft_source(d)
    for c, kind in (("sqft_source", "string"), ("sqft_verified", "boolean")):
        out[c] = F.when(source["sqft_source"].isNotNull(), source[c]).otherwise(old(c, kind))
    pairs = ((X.garage(d), "garage_count", "int", "garage_type"), (X.pool(d), "has_pool", "boolean", "pool_type"), (X.basement(d), "has_basement", "boolean", "basement_type"))
    for found, first, kind, second in pairs:
        fresh = old(first, kind).isNull() & found[first].isNotNull()
        out |= {first: F.when(fresh, found[first]).otherwise(old(first, kind)), second: F.when(fresh, found[second]).otherwise(old(second, "string"))}
    return out | {"year_built": F.coalesce(old("year_built", "long"), X.year_built(d)), "list_date": F.coalesce(old("list_date", "string"), X.list_date(d))}


def enrich_all(df: DataFrame, refs: References) -> DataFrame:
    """One plan of all enrichments: ``df`` with its gaps filled, its markers and its signals.

    Keys, URLs and coordinates come first, since lookups read them. Each lookup is asked about
    the distinct places of rows that lack its columns and bear no marker, by the columns that it
    goes by, and a commute about such rows; what it finds is put in together, and where it finds nothing <name>_checked becomes
    true, so that a later run asks no more. Rows without what a lookup needs are not asked about
    and get no mark. What a description tells is read without looking anything up; a lot
    that no parcel gives is read from it. Price signals are worked out anew. Rows stay as
    many as they were, and ``enrich_all`` of its own result changes nothing.
    """
    key = T.address_key(F.col("address"), F.col("town"), F.col("state"))
    base = geocode_join(resolve_urls(df, refs.urls), refs.places)
    # a lot is read before the joins, so that a description goes through them only where it is asked for
    base = base.withColumn("__lot_read", T.parse_lot_acres(F.col("description"))).withColumns({"address_key": F.coalesce(F.nullif("address_key", F.lit("")), key) if "address_key" in df.columns else key} | _read_description(df))
    wanted = lookups(refs)
    groups = {by: [x for x in wanted if x.by == by] for by in dict.fromkeys(x.by for x in wanted)}
    answers = {by: place_answers(base, those, by) for by, those in groups.items()}
    ride = Lookup("commute", ("town",), ("commute_minutes",), ("commute_minutes",), lambda p: commute(p, refs.stations, refs.overrides, refs.drives, refs.transits))
    rides = ride.find(base.filter(ride.asked(base.columns)).select("listing_id", "town", "lat", "lng").dropDuplicates(["listing_id"]))
    rides = rides.select("listing_id", F.when(F.col("minutes").isNotNull(), F.struct(F.col("minutes").alias("commute_minutes"))).alias("__commute"), F.col("rejected").alias("__rejected"))
    index = few(refs.index.groupBy(F.col("zip").alias("__zip")).agg(F.min("value").alias("__value")))
    columns = base.columns
    # commutes first: the others are mostly broadcast, and need not go through their shuffle
    out = base.drop("ppsf", "benchmark", "ratio", "signal").join(rides, "listing_id", "left")
    for by, found in answers.items():
        out = out.withColumn("__place", _place_key(by)).join(found, "__place", "left").drop("__place")
    asked = F.coalesce(ride.asked(columns), F.lit(False))
    old = F.col("commute_rejected") if "commute_rejected" in df.columns else F.lit(None).cast("string")
    filled = {"commute_rejected": F.when(asked, F.col("__rejected")).otherwise(old)}
    told = {f.name: f.dataType for schema in (rides.schema, *(x.schema for x in answers.values())) for f in schema.fields}
    for lookup in [*wanted, ride]:
        filled |= _fills(lookup, columns, {f.name: f.dataType for f in told[f"__{lookup.name}"].fields})
    out = out.withColumns(filled)
    out = out.join(index, F.col("zip_code") == F.col("__zip"), "left")
    signal = price_signal(F.col("price"), F.col("sqft"), F.col("__value"))
    out = out.withColumn("lot_acres", F.coalesce("lot_acres", "__lot_read")).withColumn("__signal", signal)
    return out.select(*[c for c in out.columns if not c.startswith("__")], "__signal.*")
