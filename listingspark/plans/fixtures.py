"""Deterministic views over the test tables, in SQL that Spark and DuckDB both run.

The test tables hold no listings, so queries and their SQL twins read these views. Every
value is a pure function of its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["listings_v"] = r"""
select o_orderkey as listing_id,
  concat(cast(o_orderkey % 97 + 1 as varchar(9)), ' ', case o_orderkey % 5 when 0 then 'Oak Street' when 1 then 'OAK ST.'
    when 2 then 'North Maple Avenue' when 3 then 'N Maple Ave' else 'Croton-On-Hudson Terrace' end) as address,
  n_name as town,
  case n_regionkey when 0 then 'New York' when 1 then 'ny' when 2 then 'NY' when 3 then 'New Jersey' else null end as state,
  cast(10500 + c_nationkey as varchar(9)) as zip_code,
  case when o_orderkey % 7 = 0 then null else cast(900000 + o_orderkey % 4000 as varchar(12)) end as mls_id,
  case when o_orderkey % 19 = 0 then null else cast(floor(o_totalprice * 5) as bigint) end as price,
  case when o_orderkey % 11 = 0 then null else cast(1200 + (o_orderkey * 37) % 3800 as bigint) end as sqft,
  case when o_orderkey % 13 = 0 then null else cast(1 + o_orderkey % 6 as bigint) end as bedrooms,
  case when o_orderkey % 9 = 0 then null else cast(1900 + (o_orderkey * 7) % 125 as bigint) end as year_built,
  case when o_orderpriority = '1-URGENT' then 'Price Drop' when o_orderpriority = '5-LOW' then null
    when o_orderstatus = 'O' then 'Active' when o_orderstatus = 'P' then 'Pending' else 'Sold' end as listing_status,
  case when o_orderkey % 6 = 0 then null else concat('http://www.redfin.com/NY/Town/', cast(o_orderkey as varchar(12)), '-Main-St/home/',
    cast(o_orderkey % 9000 as varchar(12)), case when o_orderkey % 3 = 0 then '' else '?riftinfo=x' end) end as listing_url,
  o_orderkey % 17 = 0 as toured, o_orderkey % 23 = 0 as liked, o_orderkey % 29 = 0 as passed, o_orderkey % 31 = 0 as tour_requested,
  case when o_orderkey % 8 = 0 then null else cast(40 + o_custkey % 100 as bigint) end as commute_minutes,
  40.9 + cast(o_orderkey % 500 as double) / 1000 as lat,
  -73.9 + cast(o_custkey % 400 as double) / 1000 as lng,
  cast((o_orderkey * 31) % 101 as bigint) as score,
  cast(70 + o_orderkey % 8 as bigint) as criteria_version,
  o_orderdate as created_at,
  case when o_orderkey % 10 = 0 then null else concat(
    case o_orderkey % 4 when 0 then 'Recently renovated home with updated kitchen. ' when 1 then 'Sold as is, needs work. '
      when 2 then 'Bright condo with community pool. ' else 'Lovely place with solar panels and water view. ' end,
    case o_orderkey % 7 when 0 then 'Finished basement. ' when 1 then 'No basement. ' when 2 then 'Walk-out basement. '
      when 3 then 'Fenced yard and deck on a corner lot. ' else '' end,
    case o_orderkey % 3 when 0 then '2-car attached garage. ' when 1 then 'Carport. ' else 'No garage. ' end,
    'HOA dues $', cast(o_orderkey % 900 as varchar(9)), '/mo. Built in ', cast(1900 + o_orderkey % 120 as varchar(9)), '. SqFt Source: ',
    case o_orderkey % 3 when 0 then 'Owner' when 1 then 'Public Records' else 'deemed reliable' end,
    '. Lot 1/4 acre, ', cast(o_orderkey % 90 + 10 as varchar(9)), '000 sqft lot. Listed on 2026-01-',
    case when o_orderkey % 28 + 1 < 10 then '0' else '' end, cast(o_orderkey % 28 + 1 as varchar(9))) end as description
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

VIEWS["scores_v"] = r"""
select o_orderkey as listing_id, cast((o_orderkey * 31) % 101 as bigint) as score,
  case when o_orderkey % 12 = 0 then 'Reject' when (o_orderkey * 31) % 101 >= 80 then 'Strong Match'
    when (o_orderkey * 31) % 101 >= 60 then 'Worth Touring' when (o_orderkey * 31) % 101 >= 40 then 'Low Priority' else 'Weak Match' end as verdict,
  case o_orderkey % 5 when 0 then '[]' when 1 then null
    when 2 then concat('[{"criterion":"', case o_orderkey % 15 when 2 then 'schools' when 7 then 'sold status' else 'detached home' end, '","passed":false,"value":"44","reason":"below floor, -10 point penalty"}]')
    when 3 then '[{"criterion":"lot","passed":null,"value":"","reason":"unknown"},{"criterion":"tax","passed":null,"value":"","reason":"unknown"}]'
    else '[{"criterion":"commute","passed":true,"value":"60","reason":"ok"}]' end as hard_results_json,
  case when o_orderkey % 6 = 0 then null else concat('{"commute":', cast(o_orderkey % 21 - 10 as varchar(9)), ',"schools":', cast(o_orderkey % 13 as varchar(9)),
    ',"unknown_lot":', cast(0 - o_orderkey % 4 as varchar(9)), '}') end as soft_points_json,
  case when o_orderkey % 10 = 3 then '["Pending enrichment"]' when o_orderkey % 10 = 4 then '["Busy road","Old roof"]' else '[]' end as concerns_json,
  case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
  case when o_orderkey % 9 = 0 then 'ai_failed' when o_orderkey % 9 < 3 then 'deterministic-gate' else 'ai' end as evaluation_method,
  cast(70 + o_orderkey % 8 as bigint) as criteria_version, o_orderdate as scored_at,
  o_orderdate + (cast(o_orderkey % 5 as int) - 2) * interval '1' day as enriched_at,
  case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 1000 as varchar(12)) end as input_fingerprint
from orders
"""

VIEWS["score_events_v"] = """
select user_id as listing_id, ts, event_id, cast(45 + (event_id * 37) % 51 as bigint) as score,
  event_type = 'signup' as criteria_rescore, event_type <> 'error' as live from events
"""

VIEWS["update_events_v"] = """
select user_id as listing_id, ts, event_id, case when event_id % 5 = 0 then null else cast(90000 + (event_id * 7919) % 900000 as bigint) end as new_price,
  case event_type when 'click' then 'Open House' when 'view' then 'Active' when 'purchase' then 'Sold' when 'error' then 'Pending' else null end as new_status,
  concat('https://www.redfin.com/home/', cast(user_id as varchar(12))) as url from events
"""

VIEWS["messages_v"] = r"""
select concat('m', cast(o_orderkey as varchar(12))) as message_id, o_orderkey as listing_id,
  case o_orderkey % 5 when 0 then 'Alerts <alerts@onehome.test>' when 1 then 'agent1@realty.test' when 2 then 'Bob <bob@homes.test>'
    when 3 then 'x@spam.test' else 'news@redfin.test' end as sender,
  case o_orderkey % 6 when 0 then 'Only sold this week' when 1 then 'Fwd: new homes' when 2 then 'FW: only active' when 3 then 'only pending' else 'Listings for you' end as subject,
  o_orderdate as ts,
  case when o_orderkey % 50 = 7 then 'Nothing to see' else concat(case when o_orderkey % 6 = 1 then concat('Hi', chr(10), '---------- Forwarded message ---------', chr(10), 'From: A', chr(10), 'Date: B', chr(10), chr(10)) else '' end,
    cast(o_orderkey % 97 + 1 as varchar(9)), ' Oak Street', chr(10), 'Rye, New York 10573', chr(10), '$', cast(100 + o_orderkey % 900 as varchar(9)), ',000', chr(10),
    cast(1 + o_orderkey % 6 as varchar(9)), ' bd 2 ba 2,437 sqft', chr(10), 'MLS #', cast(900000 + o_orderkey % 4000 as varchar(12)), chr(10), chr(10),
    case when o_orderkey % 2 = 0 then concat(cast(o_orderkey % 89 + 1 as varchar(9)), ' Elm Road', chr(10), 'Rye, New York 10574', chr(10), '$1,250,000', chr(10), '4 bd 3 ba', chr(10),
      'https://www.redfin.com/NY/Rye/', cast(o_orderkey % 89 + 1 as varchar(9)), '-Elm-Rd-10574/home/', cast(o_orderkey % 9000 as varchar(12)), '.') else 'no more' end) end as text,
  case when o_orderkey % 4 = 0 then concat('<div class="multiLineDisplay"><span class="highlight-price">$', cast(1 + o_orderkey % 3 as varchar(9)), ',295,000</span><span class="highlight-description">',
    cast(o_orderkey % 97 + 1 as varchar(9)), ' Elm St</span><span class="highlight-address">Rye Brook, New York 10573</span><p class="highlight-specs">4 bd 3 ba 2,437 sqft</p><p>MLS #',
    cast(900000 + o_orderkey % 4000 as varchar(12)), '</p><img alt="Active"/></div><div class="multiLineDisplay"><span class="highlight-price">$999,000</span><span class="highlight-address">Harrison</span></div>') when o_orderkey % 8 = 1 then '<p class="highlight-price">see below</p>' else '' end as html
from orders
"""

VIEWS["stations_v"] = """
select s_suppkey as idx, s_name as name, 40.9 + cast(s_suppkey % 500 as double) / 1000 as lat, -73.9 + cast((s_suppkey * 7) % 400 as double) / 1000 as lng from supplier
"""

VIEWS["features_v"] = """
select p_partkey as feature_id, case when p_partkey % 3 = 0 then 'tower' else 'line' end as kind,
  case when p_partkey % 4 = 0 then null else cast(100 + p_partkey % 400 as bigint) end as voltage,
  40.9 + cast((p_partkey * 13) % 500 as double) / 1000 + v * 0.0007 as lat, -73.9 + cast((p_partkey * 17) % 400 as double) / 1000 + v * 0.0005 as lng
from part cross join (select 0 as v union all select 1 union all select 2) t
"""

VIEWS["schools_v"] = """
select c_custkey as school_id, cast(10500 + c_nationkey as varchar(9)) as zip, c_name as name,
  case c_custkey % 4 when 0 then 'Elementary School' when 1 then 'Middle' when 2 then 'High School' else 'elem-mid' end as level,
  case when c_custkey % 6 = 0 then null else cast((c_custkey * 37) % 1000 as double) / 10 end as percentile from customer
"""

VIEWS["price_index_v"] = """
select cast(10500 + n_nationkey as varchar(9)) as zip, 'zip' as region_type, cast(500000 + n_nationkey * 10000 as double) as m1,
  case when n_nationkey % 2 = 0 then cast(510000 + n_nationkey * 10000 as double) else null end as m2,
  case when n_nationkey % 3 = 0 then cast(900000 + n_nationkey * 30000 as double) else null end as m3 from nation
"""

VIEWS["parcels_v"] = """
select c_custkey as parcel_id, case c_custkey % 7 when 0 then 'Putnam' when 1 then 'Dutchess' else 'Westchester' end as county,
  case when c_custkey % 6 = 0 then '' else n_name end as municipality,
  case when c_custkey % 3 = 0 then n_name else 'ELSEWHERE' end as city_town, cast(c_custkey % 97 + 1 as varchar(9)) as number,
  case c_custkey % 5 when 0 then 'OAK ST' when 1 then 'MAPLE AVE' when 2 then 'NORTH MAPLE AVENUE' when 3 then 'LAKE SHORE DR' else 'OAKLAND PL' end as street,
  case when c_custkey % 4 = 0 then 0.0 else cast(c_custkey % 50 as double) / 10 end as acres, cast(c_custkey % 70 as double) / 10 as calc_acres,
  cast(c_custkey % 9 * 100000 as bigint) as assessed, cast(c_custkey % 11 * 100000 as bigint) as market from customer join nation on c_nationkey = n_nationkey
"""

VIEWS["homes_v"] = """
select listing_id, case when listing_id % 10 = 7 then concat(cast(listing_id % 97 + 1 as varchar(9)), ' Lakeshore Drive') when listing_id % 83 = 0 then 'Nowhere' else address end as address,
  case when listing_id % 12 = 5 then 'Queens' when listing_id % 12 = 6 then 'Brooklyn' when listing_id % 89 = 0 then null else town end as town,
  case when listing_id % 14 = 3 then 'NJ' else state end as state, zip_code, price, sqft, listing_url, description, lat, lng from listings_v
"""

VIEWS["half_filled_v"] = """
select h.*, case when listing_id % 11 = 0 then 'Old Station' end as station, case when listing_id % 22 = 0 then cast(77 as bigint) end as station_m, case when listing_id % 22 = 0 then cast(1 as bigint) end as walk_min,
  case when listing_id % 7 = 0 then cast(9 as bigint) end as n_features, case when listing_id % 5 = 0 then true end as zone_checked, case when listing_id % 6 = 1 then 'old' end as tier,
  case when listing_id % 4 = 0 then 1.25 end as lot_acres, listing_id % 9 = 0 as commute_checked, case when listing_id % 9 = 0 then 'asked before' end as commute_rejected, 'stale' as signal, case when listing_id % 8 = 0 then 'kept' end as address_key,
  case when listing_id % 13 = 0 then 3 end as garage_count from homes_v h
"""

VIEWS["town_county_v"] = """
select lower(n_name) as town, case n_nationkey % 4 when 0 then 'Putnam' when 1 then 'Dutchess' else null end as county from nation where n_nationkey % 4 <> 3
"""

VIEWS["municipalities_v"] = """
select lower(a.n_name) as town, b.n_name as municipality from nation a join nation b on b.n_nationkey = (a.n_nationkey + 1) % 25 where a.n_nationkey % 5 = 0
"""

VIEWS["nyc_v"] = """
select s_suppkey as row_id, cast(s_suppkey % 5 + 1 as varchar(9)) as boro, concat(cast(s_suppkey % 97 + 1 as varchar(9)), case when s_suppkey % 2 = 0 then ' Oak Street' else ' N MAPLE AVE' end, ' APT ', cast(s_suppkey as varchar(9))) as address,
  cast(s_suppkey % 4 * 1000 as bigint) as assessed, cast(s_suppkey % 3 * 1000 as bigint) as market from supplier
"""

VIEWS["zones_v"] = """
select n_nationkey as zone_id, case n_nationkey % 3 when 0 then 'AE' when 1 then 'X' else 'VE' end as zone,
  40.9 + n_nationkey * 0.02 as lat_lo, 41.0 + n_nationkey * 0.02 as lat_hi, -73.9 + n_nationkey * 0.015 as lng_lo, -73.8 + n_nationkey * 0.015 as lng_hi from nation
"""

VIEWS["overrides_v"] = """
select lower(n_name) as town, concat('Supplier ', lpad(cast(n_nationkey + 1 as varchar(9)), 9, '0')) as station_town from nation where n_nationkey % 6 <> 0
"""

VIEWS["drives_v"] = """
select listing_id, case when listing_id % 13 = 0 then 'Elsewhere' else concat('Supplier#', lpad(cast(cast(zip_code as int) - 10499 as varchar(9)), 9, '0')) end as station,
  (listing_id * 13) % 2400 as drive_s, cast((listing_id * 7) % 90000 as double) as road_m from listings_v where listing_id % 19 <> 0
union all
select listing_id, case when listing_id % 2 = 0 then 'Farther' else concat('Supplier#', lpad(cast(cast(zip_code as int) - 10499 as varchar(9)), 9, '0')) end as station,
  (listing_id * 17) % 3600 as drive_s, cast((listing_id * 5) % 70000 as double) as road_m from listings_v where listing_id % 3 = 0
"""

VIEWS["transits_v"] = """
select s_name as station, case when s_suppkey % 17 = 0 then null else cast((s_suppkey * 2900) % 8000 as bigint) end as transit_s from supplier
union all
select s_name as station, cast((s_suppkey * 1700) % 7000 as bigint) as transit_s from supplier where s_suppkey % 5 = 0
"""

VIEWS["tasks_v"] = """
select user_id as listing_id, event_id as task_id, case event_id % 6 when 0 then 'scrape_desc' when 1 then 'stats' when 2 then 'commute' when 3 then 'schools' when 4 then 'status' else 'score' end as task_type,
  case event_type when 'click' then 'pending' when 'view' then 'done' when 'purchase' then 'failed' when 'error' then 'running' else 'pending' end as status,
  cast(event_id % 4 as bigint) as attempts from events
"""

VIEWS["alerts_v"] = """
select event_id as alert_id, user_id as listing_id, cast(45 + (event_id * 37) % 51 as bigint) as score,
  case event_id % 4 when 0 then null when 1 then 'first_time' else 're_armed' end as reason,
  case event_id % 3 when 0 then 'push' when 1 then 'slack' else null end as channel, event_id % 5 <> 0 as delivered, ts as sent_at from events
"""

VIEWS["criteria_v"] = """
select cast(o_orderkey as bigint) as version, concat(
    case o_orderkey % 4 when 0 then concat('Reject over ', cast(80 + o_orderkey % 40 as varchar(9)), ' min. A commute of 110 minutes is the limit. ') when 1 then concat('A commute of ', cast(100 + o_orderkey % 20 as varchar(9)), ' min is the limit. ')
      when 2 then 'A short commute is best. ' else '' end,
    case o_orderkey % 3 when 0 then concat('Price between $850,000 and $', cast(2 + o_orderkey % 2 as varchar(9)), ',250,000. ') when 1 then 'Price between 900,000 - 2,250,000. ' else '' end,
    case o_orderkey % 5 when 0 then '' when 1 then 'Minimum 2,400 sq. ft. ' else 'Minimum 2,200 sqft. ' end, case when o_orderkey % 2 = 0 then concat('Minimum ', cast(3 + o_orderkey % 3 as varchar(9)), ' bedrooms. ') else '' end,
    case when o_orderkey % 7 < 3 then 'Schools below 50th percentile. ' when o_orderkey % 7 = 3 then 'Schools below 42nd percentile. ' else '' end, case when o_orderkey % 11 < 5 then 'Base score: 50.' else '' end) as instructions,
  o_orderstatus as created_by from orders
"""

VIEWS["export_v"] = """
select listing_id % 9000 as home_id, address, town, state, zip_code, case when listing_id % 4 = 0 then price + 1000 when listing_id % 4 = 1 then null else price end as price,
  listing_status as status, sqft, bedrooms, year_built, cast((listing_id % 60) * 1000 as double) as lot_sqft, listing_id
from listings_v where listing_id % 3 = 0 and listing_id % 6 <> 0
"""


NEEDS = {"half_filled_v": ["listings_v", "homes_v"], "export_v": ["listings_v"], "homes_v": ["listings_v"], "drives_v": ["listings_v"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame, over the tables of ``sf_dir``."""
    tables = "customer nation orders events supplier part pages".split()
    sql = VIEWS[name]
    given = {}
    for needed in NEEDS.get(name, []):
        given[needed] = view(spark, sf_dir, needed)
    for t in tables:
        given[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    import re

    used = {k: v for k, v in given.items() if re.search(rf"\b{k}\b", sql)}
    text = re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)", r"{\1}", sql.replace("{", "{{").replace("}", "}}")) if used else sql
    return spark.sql(text, **used) if used else spark.sql(sql)


def ctes(names: list[str]) -> str:
    """A WITH clause of the views for the SQL twins."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
