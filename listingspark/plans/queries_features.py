"""Queries of description features."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import features as X
from listingspark.functions import text as T
from listingspark.registry import query

L = ["listings_v"]


def m(pattern: str, c: str = "lower(description)") -> str:
    return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def chain(rules, c: str = "lower(description)") -> str:
    return "case " + " ".join(f"when {m(p, c)} then '{n}'" for p, n in rules) + " end"


@query("c01_garage", L)
def _(v):
    return v("listings_v").select("listing_id", X.garage(F.col("description")).alias("g")).select("listing_id", "g.*")


@query("c02_hoa", L)
def _(v):
    return v("listings_v").select("listing_id", X.hoa(F.col("description")).alias("h")).select("listing_id", "h.*")


@query(
    "c03_pool",
    L,
    f"select listing_id, case when description is null then null when {m(X.POOL_COMMUNITY)} then false when {m(X.POOL_ABOVE)} or {m(X.POOL_IN)} or ({m(X.POOL_ANY)} and not {m(X.POOL_NOT)}) then true else false end as has_pool, "
    f"case when {m(X.POOL_COMMUNITY)} then 'community' when {m(X.POOL_ABOVE)} then 'above_ground' when {m(X.POOL_IN)} or ({m(X.POOL_ANY)} and not {m(X.POOL_NOT)}) then 'inground' end as pool_type from listings_v",
)
def _(v):
    return v("listings_v").select("listing_id", X.pool(F.col("description")).alias("p")).select("listing_id", "p.*")


@query(
    "c04_basement",
    L,
    f"""select listing_id, case when {m(X.NO_BASEMENT)} then false when {m(X.WALK_OUT)} or {m(X.PART_FINISHED)} or {m(X.FINISHED)} or {m(X.UNFINISHED)} or {m(X.BASEMENT)} then true end as has_basement,
    case when {m(X.NO_BASEMENT)} then null when {m(X.WALK_OUT)} then 'walk_out' when {m(X.PART_FINISHED)} then 'partially_finished' when {m(X.FINISHED)} then 'finished' when {m(X.UNFINISHED)} then 'unfinished' end as basement_type,
    case when {m(X.NO_BASEMENT)} then false when {m(X.WALK_OUT)} then true when {m(X.PART_FINISHED)} then {m(X.GYM)} when {m(X.FINISHED)} then {m(X.GYM)} or not {m(X.CRAMPED)} when {m(X.UNFINISHED)} then false when {m(X.BASEMENT)} then {m(X.GYM)} end as basement_gym_suitable from listings_v""",
)
def _(v):
    return v("listings_v").select("listing_id", X.basement(F.col("description")).alias("b")).select("listing_id", "b.*")


@query("c05_sqft_source", L, "select listing_id, case listing_id % 3 when 0 then 'owner' when 1 then 'municipality' end as sqft_source, case listing_id % 3 when 0 then false when 1 then true end as sqft_verified from listings_v where description is not null")
def _(v):
    return v("listings_v").filter("description is not null").select("listing_id", X.sqft_source(F.col("description")).alias("s")).select("listing_id", "s.*")


@query("c06_property_type", L, f"select listing_id, {chain(X.TYPE_RULES)} as inferred_type from listings_v")
def _(v):
    return v("listings_v").select("listing_id", X.property_type_from_text(F.col("description")).alias("inferred_type"))


@query(
    "c07_c10_flags",
    L,
    "select listing_id, " + ", ".join(f"coalesce({m(p)}, false) as {n}" for n, p in X.FLAGS.items()) + ", " + ", ".join(f"{chain(r)} as {n}" for n, r in X.LEVELS.items()) + rf", try_cast(nullif(regexp_extract(lower(description), '{X.LOT_COUNT}', 1), '') as int) as lot_count from listings_v",
)
def _(v):
    d = F.col("description")
    return v("listings_v").select("listing_id", X.energy(d).alias("e"), X.views(d).alias("w"), X.outdoor(d).alias("o"), X.lot_traits(d).alias("t")).select("listing_id", "e.*", "w.*", "o.*", "t.*")


@query("c11_list_date", L, rf"select listing_id, nullif(regexp_extract(lower(description), '{X.LISTED}(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') as list_date from listings_v")
def _(v):
    return v("listings_v").select("listing_id", X.list_date(F.col("description")).alias("list_date"))


@query(
    "c12_year_built",
    L,
    "select listing_id, coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(lower(description), '{p}', 1), '') as bigint)" for p in X.YEAR_RULES) + ") as text_year from listings_v",
)
def _(v):
    return v("listings_v").select("listing_id", X.year_built(F.col("description")).alias("text_year"))


POINTS = " + ".join(f"(case when contains(lower(coalesce(description, '')), '{k}') then {p} else 0 end)" for k, p in X.CONDITIONS)
TIERS = "case when year_built is null then 'unknown' " + " ".join(f"when year_built < {y} then '{n}'" for y, _, n in X.AGE_TIERS) + " else '2005+' end"
AGES = "case when year_built is null then 0 " + " ".join(f"when year_built < {y} then {p}" for y, p, _ in X.AGE_TIERS) + " else 0 end"
HITS = "concat_ws(',', " + ", ".join(f"case when contains(lower(coalesce(description, '')), '{k}') then '{k}' end" for k, _ in X.CONDITIONS) + ")"


@query("c13_age_condition", L, f"select listing_id, {AGES} as age_adjustment, {TIERS} as age_tier, greatest(-12, least(6, {POINTS})) as condition_adjustment, {HITS} as keywords from listings_v")
def _(v):
    out = v("listings_v").select("listing_id", X.age_condition(F.col("year_built"), F.col("description")).alias("a"))
    return out.select("listing_id", "a.age_adjustment", "a.age_tier", "a.condition_adjustment", F.array_join("a.keywords_matched", ",").alias("keywords"))


SHARES = {n: f"coalesce({m(p)}, false)" for n, p in X.FLAGS.items()} | {
    "has_pool": f"coalesce(not {m(X.POOL_COMMUNITY)} and ({m(X.POOL_ABOVE)} or {m(X.POOL_IN)} or ({m(X.POOL_ANY)} and not {m(X.POOL_NOT)})), false)",
    "has_basement": f"coalesce(not {m(X.NO_BASEMENT)} and ({m(X.WALK_OUT)} or {m(X.PART_FINISHED)} or {m(X.FINISHED)} or {m(X.UNFINISHED)} or {m(X.BASEMENT)}), false)",
    "year_built": "coalesce(regexp_matches(lower(description), '" + "|".join(X.YEAR_RULES) + "'), false)",
    "list_date": rf"coalesce(regexp_matches(lower(description), '{X.LISTED}\d{{4}}-\d{{2}}-\d{{2}}'), false)",
}


@query("c14_feature_prevalence", L, "select town, feature, round(share, 6) as share from (" + " union all ".join(f"select town, '{n}' as feature, avg(({t})::int) as share from listings_v group by town" for n, t in SHARES.items()) + ")")
def _(v):
    return X.feature_prevalence(v("listings_v"), "town").withColumn("share", F.round("share", 6))


@query("b06_property_types", None, "select p_partkey, case p_partkey % 4 when 0 then 'Condo/Co-op' when 1 then 'Townhouse' when 2 then 'Single Family Residential' else 'Farm House' end as kind from part")
def _(v):
    raw = F.element_at(F.array(*map(F.lit, ["CONDO unit", "townhouse", "Single Family", "farm house"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return v.table("part").select("p_partkey", T.canonical_property_type(raw).alias("kind"))


@query(
    "b07_list_dates",
    None,
    "select event_id, case event_id % 5 when 4 then null else make_date(2020 + event_id % 6, 1 + event_id % 12, 1 + event_id % 28) end as day from events",
)
def _(v):
    i = F.col("event_id")
    y, mo, d = 2020 + i % 6, 1 + i % 12, 1 + i % 28
    months = F.array(*map(F.lit, "January February March April May June July August September October November December".split()))
    s = lambda x: x.cast("string")
    raw = (
        F.when(i % 5 == 0, F.format_string("%04d-%02d-%02d", y, mo, d))
        .when(i % 5 == 1, F.concat_ws("/", s(mo), s(d), s(y)))
        .when(i % 5 == 2, F.concat_ws("-", s(mo), s(d), F.substring(s(y), 3, 2)))
        .when(i % 5 == 3, F.concat(F.when(i % 2 == 0, F.element_at(months, mo.cast("int"))).otherwise(F.concat(F.substring(F.element_at(months, mo.cast("int")), 1, 3), F.lit("."))), F.lit(" "), s(d), F.lit(", "), s(y)))
        .otherwise("13/45/2020")
    )
    return v.table("events").select("event_id", T.parse_list_date_text(raw).alias("day"))


@query("b08_lot_acres", L, "select listing_id, round((listing_id % 90 + 10) * 1000 / 43560.0, 4) as lot_acres from listings_v where description is not null and listing_id % 90 > 0")
def _(v):
    return v("listings_v").filter("description is not null and listing_id % 90 > 0").select("listing_id", T.parse_lot_acres(F.col("description")).alias("lot_acres"))
