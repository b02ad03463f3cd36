"""Queries of joins with reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import enrich as E
from listingspark.plans import sqltext as S
from listingspark.registry import query

L = ["listings_v"]


@query("e01_haversine", L, f"select listing_id, cast(round({S.haversine('lat', 'lng', '40.7', '-74.0')}) as bigint) as m from listings_v")
def _(v):
    from listingspark.functions.geo import haversine_m

    return v("listings_v").select("listing_id", F.round(haversine_m(F.col("lat"), F.col("lng"), F.lit(40.7), F.lit(-74.0))).cast("long").alias("m"))


NEAREST = f""", d as (select l.listing_id, s.name, s.idx, {S.haversine('l.lat', 'l.lng', 's.lat', 's.lng')} as m from listings_v l cross join stations_v s),
    n as (select *, row_number() over (partition by listing_id order by m, idx) as q from d) select listing_id, name as station, cast(round(m) as bigint) as station_m, cast(round(m / 83) as bigint) as walk_min from n where q = 1"""


@query("e02_nearest_station", ["listings_v", "stations_v"], NEAREST)
def _(v):
    return E.nearest_station(v("listings_v").select("listing_id", "lat", "lng"), v("stations_v")).select("listing_id", "station", "station_m", "walk_min")


@query(
    "e03_within_radius",
    ["listings_v", "features_v"],
    f""", h as (select l.listing_id, f.feature_id, min({S.haversine('l.lat', 'l.lng', 'f.lat', 'f.lng')}) as m from listings_v l join features_v f on abs(l.lat - f.lat) < 0.003 and abs(l.lng - f.lng) < 0.004 group by 1, 2),
    g as (select listing_id, count(*) as n_features, round(min(m), 1) as nearest_m from h where m <= 300 group by 1) select l.listing_id, coalesce(n_features, 0) as n_features, nearest_m, n_features is not null as found from listings_v l left join g using (listing_id)""",
)
def _(v):
    return E.within_radius(v("listings_v"), v("features_v")).select("listing_id", "n_features", "nearest_m", "found")


ZONES = "select listing_id, min(zone_id) as zone_id, arg_min(zone, zone_id) as zone from {} join zones_v on lat >= lat_lo and lat < lat_hi and lng >= lng_lo and lng < lng_hi group by 1"


@query("e04_zone_lookup", ["listings_v", "zones_v"], f", z as ({ZONES.format('listings_v')}) select listing_id, zone_id, zone, left(upper(zone), 1) in ('A', 'V') as sfha from listings_v left join z using (listing_id)")
def _(v):
    return E.zone_lookup(v("listings_v"), _zones(v))


def _zones(v):
    p = lambda a, b: F.struct(F.col(a).cast("double").alias("lat"), F.col(b).cast("double").alias("lng"))
    ring = F.array(p("lat_lo", "lng_lo"), p("lat_hi", "lng_lo"), p("lat_hi", "lng_hi"), p("lat_lo", "lng_hi"))
    return v("zones_v").select("zone_id", "zone", ring.alias("ring"))


HOUSE = r"""a as (select listing_id, address, town, state, regexp_extract(trim(address), '^(\S+)\s+(.*)$', 1) as number, upper(trim(regexp_extract(trim(address), '^(\S+)\s+(.*)$', 2))) as street from homes_v),
    c as (select a.*, upper(trim(coalesce(a.town, ''))) as up, case when t.town is not null then t.county else 'Westchester' end as county from a left join town_county_v t on t.town = lower(trim(a.town)))"""
TWO = "array_to_string(string_split({}, ' ')[1:2], ' ')"
COMPOUNDS = ", ".join(f"({k + 1}, '{a}', '{b.split()[0]}')" for k, (a, b) in enumerate(E.STREET_COMPOUNDS))
LOT = f"""with {HOUSE}, d as (select * from c where coalesce(left(upper(trim(state)), 2), '') not in ('NJ', 'CT', 'PA', 'MA') and county is not null and number <> '' and street <> ''),
    t as (select d.*, 0 as turn, split_part(street, ' ', 1) as word from d union all select d.*, k.turn, k.word from d join (values {COMPOUNDS}) k(turn, compound, word) on starts_with(street, compound)),
    m as (select t.listing_id, t.up, t.street, t.turn, p.parcel_id, p.street as ps, p.municipality as muni, p.city_town as city, case when p.acres > 0 then p.acres when p.calc_acres > 0 then p.calc_acres end as lot
      from t join parcels_v p on p.county = t.county and p.number = t.number and starts_with(p.street, t.word)),
    f as (select listing_id, min(turn) as turn from m group by 1),
    r as (select m.*, count(*) over (partition by listing_id) as n, case when {TWO.format('street')} = {TWO.format('ps')} and contains({TWO.format('street')}, ' ') then 3 when contains(muni, up) or contains(up, muni) then 2 when contains(city, up) or contains(up, city) then 1 else 0 end as rk
      from m join f using (listing_id, turn)),
    b as (select *, row_number() over (partition by listing_id order by -rk, parcel_id) as q from r where lot is not null and (rk > 0 or n = 1)) select listing_id, round(lot, 4) as lot_acres from b where q = 1"""


@query("e05_parcel_lot_acres", ["homes_v", "parcels_v", "town_county_v"], f", out as ({LOT}) select * from out")
def _(v):
    return E.parcel_lot_acres(v("homes_v"), v("parcels_v"), v("town_county_v"))


TAX = f"""with {HOUSE}, d as (select c.*, split_part(street, ' ', 1) as word, upper(coalesce(g.municipality, c.town)) as muni,
      case lower(c.town) when 'manhattan' then '1' when 'bronx' then '2' when 'brooklyn' then '3' when 'queens' then '4' when 'staten island' then '5' else lower(c.town) end as boro
      from c left join municipalities_v g on g.town = lower(c.town) where c.town is not null and street <> ''),
    x as (select listing_id, 1 as tier, row_id as id, n.assessed, n.market from d join nyc_v n on n.boro = d.boro and starts_with(upper(n.address), upper(trim(d.address)))
      union all select listing_id, 2, parcel_id, assessed, market from d join parcels_v p on upper(p.municipality) = d.muni and p.number = d.number and starts_with(split_part(p.street, ' ', 1), d.word)
      union all select listing_id, 3, parcel_id, assessed, market from d join parcels_v p on p.county = d.county and p.number = d.number and starts_with(split_part(p.street, ' ', 1), d.word)),
    o as (select *, row_number() over (partition by listing_id order by tier, id) as q from x)
    select listing_id, nullif(assessed, 0) as assessed, nullif(market, 0) as market, case tier when 1 then 'city' when 2 then 'municipality' else 'county' end as tier from o where q = 1"""
TAX_VIEWS = ["homes_v", "parcels_v", "town_county_v", "nyc_v", "municipalities_v"]


@query("e06_property_tax", TAX_VIEWS, f", out as ({TAX}) select * from out")
def _(v):
    return E.property_tax(v("homes_v"), v("parcels_v"), v("town_county_v"), v("nyc_v"), v("municipalities_v"))


@query(
    "e07_schools_by_zip",
    ["listings_v", "schools_v"],
    """, k as (select *, case when contains(lower(level), 'elem') then 'elementary' when contains(lower(level), 'mid') then 'middle' when contains(lower(level), 'high') then 'high' end as kind from schools_v),
    r as (select *, row_number() over (partition by zip, kind order by coalesce(percentile, 0) desc, school_id) as rn from k where kind is not null),
    t as (select zip, kind, string_agg(name, ',' order by rn) as names, max(percentile) as best from r where rn <= 3 group by 1, 2) select listing_id, kind as level, names, best from listings_v join t on zip = zip_code""",
)
def _(v):
    return E.schools_by_zip(v("listings_v"), v("schools_v"))


INDEX = "ix as (select zip, m3 as value from price_index_v where m3 is not null)"


@query("a07_price_index", ["price_index_v"], f", {INDEX} select * from ix")
def _(v):
    return E.read_wide_index(v("price_index_v"), ["m1", "m2", "m3"])


@query(
    "e09_price_signal",
    ["listings_v", "price_index_v"],
    f""", {INDEX}, p as (select listing_id, price / sqft as ppsf, value / 1500 as bench from listings_v left join ix on zip = zip_code where price is not null and sqft > 0 and value > 0)
    select listing_id, round(ppsf, 1) as ppsf, case when ppsf / bench < 0.85 then 'below_market' when ppsf / bench > 1.2 then 'above_market' else 'at_market' end as signal from p""",
)
def _(v):
    index = E.read_wide_index(v("price_index_v"), ["m1", "m2", "m3"])
    out = E.price_per_sqft_signal(v("listings_v"), index).filter("ppsf is not null").drop("ppsf")
    return out.join(v("listings_v").select("listing_id", F.round(F.col("price") / F.col("sqft"), 1).alias("ppsf")), "listing_id").select("listing_id", "ppsf", "signal")


FOLDED = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
RIDE = f"""with s as (select {FOLDED.format('name')} as k, min((idx, name, lat, lng)) as s from stations_v group by 1),
    g as (select h.listing_id, h.lat, h.lng, s.s[2] as station, s.s[3] as slat, s.s[4] as slng from homes_v h left join overrides_v o on o.town = lower(h.town) left join s on s.k = {FOLDED.format('coalesce(o.station_town, h.town)')}),
    d as (select listing_id, station, min((drive_s, road_m)) as d from drives_v where drive_s > 0 group by 1, 2), t as (select station, min(transit_s) as transit_s from transits_v where transit_s > 0 group by 1),
    w as (select g.*, d.d[1] as drive_s, d.d[2] as road_m, transit_s, {S.haversine('lat', 'lng', 'slat', 'slng')} as straight_m from g left join d on d.listing_id = g.listing_id and d.station = g.station left join t on t.station = g.station),
    r as (select *, case when station is null then 'no_station' when drive_s is null or transit_s is null then 'missing_leg' when transit_s > 7200 then 'transit_too_long' when drive_s > 1800 then 'drive_too_long' when road_m > greatest(3 * straight_m, 5000) then 'road_too_long' end as rejected from w)
    select listing_id, station, case when rejected is null then cast(round_even((drive_s + transit_s) / 60, 0) as bigint) end as minutes, rejected from r"""
RIDE_VIEWS = ["homes_v", "stations_v", "overrides_v", "drives_v", "transits_v"]


@query("e10_commute", RIDE_VIEWS, f", out as ({RIDE}) select * from out")
def _(v):
    return E.commute(v("homes_v"), v("stations_v"), v("overrides_v"), v("drives_v"), v("transits_v"))


@query("e11_e12_parse", L, "select listing_id, cast(round_even(coalesce(try_cast(rtrim(case when listing_id % 3 = 0 then 'bad' else concat(cast(listing_id % 1000 as varchar), '.25s') end, 's') as double), 0), 0) as bigint) as seconds, regexp_replace(lower(address), '[^a-z0-9]', '', 'g') as folded from listings_v")
def _(v):
    raw = F.when(F.col("listing_id") % 3 == 0, "bad").otherwise(F.concat((F.col("listing_id") % 1000).cast("string"), F.lit(".25s")))
    return v("listings_v").select("listing_id", T.parse_duration(raw).alias("seconds"), T.fold_place(F.col("address")).alias("folded"))


@query("e13_departure_slot", None)
def _(v):
    return v.table("events").select("event_id", E.departure_slot(F.col("ts").cast("timestamp")).alias("departs"))


@query("e14_invalidate_commutes", L, "select listing_id, case when not listing_id % 45 > 30 then commute_minutes end as commute_minutes, listing_id % 45 > 30 as condemned, listing_id % 2 = 0 as other_station from listings_v")
def _(v):
    i = F.col("listing_id")
    rows = v("listings_v").withColumns({"drive_minutes": i % 45, "station": F.lit("Rye"), "used_station": F.when(i % 2 == 0, "Harrison").otherwise("Rye Station")})
    return E.invalidate_commutes(rows)


@query("e15_clear_stale_commutes", L, "select listing_id, case when not (listing_id % 10 = 0 or coalesce(commute_minutes > 130, false) or town = 'CHINA') then commute_minutes end as commute_minutes from listings_v")
def _(v):
    rows = v("listings_v").withColumn("commute_mode", F.when(F.col("listing_id") % 10 == 0, "transit").otherwise("drive"))
    return E.clear_stale_commutes(rows, ["CHINA"], 130).select("listing_id", "commute_minutes")


@query("e16_clear_bogus_schools", L, "select listing_id, case when listing_id % 4 = 0 then null else 1 end as n_schools from listings_v")
def _(v):
    name = F.when(F.col("listing_id") % 4 == 0, "School #7").otherwise("Elm School")
    rows = v("listings_v").withColumn("schools", F.array(F.struct(name.alias("name"), F.lit(1.0).alias("percentile"))))
    return E.clear_bogus_schools(rows).select("listing_id", F.when(F.col("schools").isNotNull(), F.size("schools")).alias("n_schools"))


@query("e17_resolve_urls", L, "select listing_id, coalesce(listing_url, (select concat('https://www.redfin.com/p/', lower(x.address)) from (select 1) q, (select l.address) x)) as listing_url from listings_v l")
def _(v):
    ref = v("listings_v").select("address", "town", F.concat(F.lit("/p/"), F.lower("address")).alias("url"))
    return E.resolve_urls(v("listings_v"), ref).select("listing_id", "listing_url")


@query("e18_geocode_join", L, ", g as (select lower(trim(address)) as a, lower(trim(town)) as t, lower(trim(coalesce(state, ''))) as s, min((lat, lng)) as g from listings_v where listing_id % 2 = 0 group by 1, 2, 3) select listing_id, case when listing_id % 2 = 0 then lat else g.g[1] end as lat from listings_v left join g on a = lower(trim(address)) and t = lower(trim(town)) and s = lower(trim(coalesce(state, '')))")
def _(v):
    rows = v("listings_v")
    ref = rows.filter("listing_id % 2 = 0")
    odd = F.col("listing_id") % 2 != 0
    blank = rows.withColumns({"lat": F.when(~odd, F.col("lat")), "lng": F.when(~odd, F.col("lng"))})
    return E.geocode_join(blank, ref).select("listing_id", "lat")


@query("e19_fix_sentinel_lot", L, "select listing_id, cast(4.0 as double) as old, case when description is null then null else round((listing_id % 90 + 10) * 1000 / 43560.0, 4) end as new from listings_v where listing_id % 6 = 1")
def _(v):
    rows = v("listings_v").withColumn("lot_acres", F.when(F.col("listing_id") % 6 == 1, 4.0))
    return E.fix_sentinel_lot(rows)


NEAR_HOME = NEAREST.replace("listings_v", "homes_v").removeprefix(", ")


@query(
    "e20_enrich_all",
    [*TAX_VIEWS, *RIDE_VIEWS, "half_filled_v", "features_v", "zones_v", "price_index_v", "schools_v"],
    f""", {INDEX}, near as (with {NEAR_HOME}), power as (select l.listing_id, count(distinct feature_id) as n_features from homes_v l join features_v f on abs(l.lat - f.lat) < 0.003 and abs(l.lng - f.lng) < 0.004 and {S.haversine('l.lat', 'l.lng', 'f.lat', 'f.lng')} <= 300 group by 1),
    z as ({ZONES.format('homes_v')}), lot as ({LOT}), tax as ({TAX}), ride as ({RIDE}),
    k as (select *, case when contains(lower(level), 'elem') then 'elementary' when contains(lower(level), 'mid') then 'middle' when contains(lower(level), 'high') then 'high' end as kind from schools_v),
    sch as (select zip, max(percentile) as best from (select *, row_number() over (partition by zip, kind order by coalesce(percentile, 0) desc, school_id) as rn from k where kind = 'elementary') where rn <= 3 group by 1),
    p as (select listing_id, case when price / sqft / (value / 1500) < 0.85 then 'below_market' when price / sqft / (value / 1500) > 1.2 then 'above_market' else 'at_market' end as signal from homes_v join ix on zip = zip_code where price is not null and sqft > 0 and value > 0)
    select h.listing_id, case when h.walk_min is not null then h.station else near.station end as station, case when h.walk_min is not null then h.station_m else near.station_m end as station_m,
      case when h.walk_min is not null then h.walk_min else near.walk_min end as walk_min, coalesce(h.n_features, power.n_features) as n_features, coalesce(h.n_features, power.n_features) is null as power_checked,
      case when h.zone_checked is null then zone end as zone, h.zone_checked is not null or zone is null as zone_checked,
      case when h.tier is null then assessed end as assessed, case when h.tier is null then market end as market, coalesce(h.tier, tax.tier) as tier, coalesce(h.tier, tax.tier) is null and town is not null as tax_checked,
      sch.best as best_elementary, p.signal, case when not h.commute_checked then ride.minutes end as commute_minutes,
      case when h.commute_checked then h.commute_rejected when town is not null then ride.rejected end as commute_rejected, h.commute_checked or (town is not null and ride.minutes is null) as commute_checked,
      coalesce(h.lot_acres, lot.lot_acres, case when description is not null then round((h.listing_id % 90 + 10) * 1000 / 43560.0, 4) end) as lot_acres, h.lot_acres is null and lot.lot_acres is null as lot_checked,
      coalesce(h.address_key, {S.address_key('h.address', 'h.town', 'h.state')}) as address_key, coalesce(h.garage_count, case when description is not null then case h.listing_id % 3 when 0 then 2 when 1 then 1 else 0 end end) as garage_count
    from half_filled_v h left join near using (listing_id) left join power using (listing_id) left join z using (listing_id) left join lot using (listing_id) left join tax using (listing_id) left join ride using (listing_id) left join sch on sch.zip = h.zip_code left join p using (listing_id)""",
)
def _(v):
    """Homes of which some have values, some marks of earlier runs."""
    best = F.get(F.filter("schools", lambda x: x["level"] == "elementary"), F.lit(0))["best"].alias("best_elementary")
    columns = "listing_id station station_m walk_min n_features power_checked zone zone_checked assessed market tier tax_checked signal commute_minutes commute_rejected commute_checked lot_acres lot_checked address_key garage_count".split()
    return E.enrich_all(v("half_filled_v"), references(v, v("homes_v"))).select(*columns, best)


def references(v, homes):
    """The fixture's reference tables."""
    return E.References(
        stations=v("stations_v"), index=E.read_wide_index(v("price_index_v"), ["m1", "m2", "m3"]), features=v("features_v"), zones=_zones(v), parcels=v("parcels_v"), rolls=v("parcels_v"), nyc=v("nyc_v"),
        municipalities=v("municipalities_v"), town_county=v("town_county_v"), schools=v("schools_v"), overrides=v("overrides_v"), drives=v("drives_v"), transits=v("transits_v"),
        places=homes.select("address", "town", "state", "lat", "lng"), urls=homes.select("address", "town", F.lit("/p").alias("url")),
    )
