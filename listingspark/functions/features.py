"""Text features of a listing's description, as ordered rules of native expressions.

The patterns are fixed values. All are matched in lower case. A null or empty description
gives nulls, or false where a feature is a plain flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions.text import extract, number

NO_GARAGE = r"\bno garage\b|\bwithout garage\b|\bno attached garage\b"
GARAGE_COUNT = (
    r"\b([1-9])\s*[-–]?\s*car\b(?:\s+(?:attached|detached))?\s*garage\b|\bgarage\s+(?:with\s+)?([1-9])\s*[-–]?\s*car\b"
    r"|\b([1-9])\s*[-–]?\s*car\s+(?:attached|detached)\b"
)
NO_HOA = r"\bno hoa\b|\bno association fee\b|\bhoa\s*(?:fee|dues|is|:)?\s*\$\s*0\b"
HOA_MONTHLY = (
    r"\$\s*(\d[\d,]*)\s*/\s*(?:mo|month)\b",
    r"\$\s*(\d[\d,]*)\s*per\s+month",
    r"\bhoa\s*(?:fee|dues|is|:)?\s*\$\s*(\d[\d,]*)\b",
    r"\bmonthly\s+(?:hoa|dues|association\s+fee)\s*(?:is|of|:)?\s*\$\s*(\d[\d,]*)\b",
    r"\bassociation\s+fees?\s*(?:of|is|:)?\s*\$\s*(\d[\d,]*)\s*(?:/mo|/month|per\s+month)\b",
)
YEARLY = r"\s*(?:/\s*(?:yr|year)|per\s+year|annually)"
HOA_ANNUAL = (
    r"\$\s*(\d[\d,]*)\s*/\s*(?:yr|year)\b",
    r"\$\s*(\d[\d,]*)\s*(?:per\s+year|annually)\b",
    r"\bhoa\s*(?:fee|dues|is|:)?\s*\$\s*(\d[\d,]*)\s*(?:per\s+year|annually|/yr|/year)\b",
)
POOL_COMMUNITY = r"\bcommunity\s+pool\b|\bhoa\s+pool\b|\bclub(?:house)?\s+pool\b"
POOL_ABOVE = r"\babove[\s-]ground\s+pool\b|\babove\s+grade\s+pool\b"
POOL_IN = r"\bin[\s-]ground\s+pool\b|\binground\s+pool\b"
POOL_ANY = r"\bswimming\s+pool\b|\bpool\b"
POOL_NOT = r"\bpool\s+table\b|\bcar\s*pool\b|\bpool\s+of\b"
NO_BASEMENT = r"\bno basement\b|\bslab foundation\b|\bslab\s+on\s+grade\b|\bcrawl\s*space\b"
GYM = (
    r"\bgym\b|\bfitness\s+(?:room|space|center)\b|\bworkout\s+(?:room|space)\b|\bexercise\s+(?:room|space)\b|"
    r"\brubber\s+(?:flooring|floor)\b|\bhigh\s+ceilings?\b|\brecreation\s+room\b|\brec\s+room\b"
)
WALK_OUT = r"\bwalk[\s-]?out\s+basement\b|\bwalkout\s+basement\b|\bwalk[\s-]?out\s+lower\b"
PART_FINISHED = r"\bpartially?\s+finished\s+basement\b|\bhalf\s+finished\s+basement\b|\bpartial(?:ly)?\s+finished\s+(?:lower|basement)\b"
FINISHED = r"\bfinished\s+basement\b|\bfully\s+finished\s+(?:lower|basement)\b|\bbasement.*finished\b"
CRAMPED = r"\btiny\b|\bsmall\b|\bcompact\b|\bcramped\b|\blimited\s+space\b"
UNFINISHED = r"\bunfinished\s+basement\b|\bfull\s+basement\b|\bbasement\s+(?:with\s+)?(?:utility|storage|laundry|mechanicals)\b"
BASEMENT = (
    r"\bbasement\b|\blower\s+level\b|\bfinished\s+lower\b|\blower\s+level\s+bedroom\b|\bdownstairs\s+(?:bedroom|suite|apartment)\b|"
    r"\bbelow[\s-]?grade\b|\bsubterranean\b|\bsemi[\s-]?finished\s+lower\b"
)
SQFT_SOURCE = r"(?i)(?:sq(?:uare)?\s*\.?\s*(?:ft|feet|footage)\s*\.?|living\s+area|gla)\s*(?:source|src)\s*(?:is|:|=|-|–|—)?\s*([A-Za-z][A-Za-z' ]{1,28})"
SOURCE_OF_SQFT = (
    r"(?i)source\s+of\s+(?:the\s+)?(?:sq(?:uare)?\s*\.?\s*(?:ft|feet|footage)\s*\.?|living\s+area)\s*(?:is|:|=|-|–|—)?\s*([A-Za-z][A-Za-z' ]{1,28})"
)
SQFT_VERIFIED = {
    "municipality": ("municipality", "municipal", "town", "city", "village", "assessor", "assessors", "tax record", "tax records", "public record", "public records", "county"),
}
SQFT_STATED = {
    "owner": ("owner", "owners", "seller", "sellers", "landlord"),
    "estimated": ("estimated", "estimate", "approximate", "approximated"),
    "builder": ("builder", "developer"),
    "appraiser": ("appraiser", "appraisal"),
    "agent": ("agent", "broker", "listing agent", "agent measured"),
    "plans": ("plans", "floor plans", "architect", "architectural plans", "blueprints"),
    "other": ("other",),
}
TYPE_RULES = (
    (r"\b(?:multi[\s-]?family|multifamily|two[\s-]?family|3[\s-]?family|four[\s-]?family|duplex|triplex)\b", "Multi-Family"),
    (r"\b(?:townhouse|townhome|town\s+home|attached\s+home)\b", "Townhouse"),
    (r"\b(?:condo|condominium|co[\s-]?op|cooperative)\b", "Condo/Co-op"),
    (r"\b(?:single[\s-]?family|single[\s-]?family\s+(?:home|residence)|detached\s+home|single\s+home)\b", "Single Family Residential"),
    (
        r"\b(?:colonial|ranch|cape\s+cod|split[\s-]?level|contemporary|victorian|tudor|farmhouse|craftsman|mediterranean|modern|cape|spanish|french\s+country)\b",
        "Single Family Residential",
    ),
    (r"\b(?:mobile\s+home|manufactured\s+home|trailer|rv|motorhome)\b", "Mobile/Manufactured Home"),
)
FLAGS = {
    "has_solar": r"\bsolar\b",
    "has_geothermal": r"\bgeothermal\b|\bgeo[\s-]?thermal\b",
    "high_efficiency": r"\b(?:energy[\s-]?(?:efficient|saving)|high[\s-]?efficiency|energy[\s-]?star|efficient\s+(?:hvac|heating|cooling)|modern\s+systems|upgraded\s+systems)\b",
    "has_water_view": r"\b(?:water\s+view|lake\s+view|river\s+view|ocean\s+view|waterfront|water\s+access)\b",
    "has_mountain_view": r"\b(?:mountain\s+view|hill\s+view|mountain\s+range|scenic\s+view|rolling\s+hills)\b",
    "has_city_view": r"\b(?:city\s+view|skyline|city\s+skyline|urban\s+view|manhattan\s+view)\b",
    "has_fenced_yard": r"\bfenced\s+(?:yard|property|lot)\b|\bfencing\b|\bprivate\s+fence\b",
    "has_patio_deck": r"\b(?:patio|deck|terrace|screened\s+porch|covered\s+porch|pergola)\b",
    "has_mature_trees": r"\b(?:mature\s+(?:trees|landscaping)|established\s+(?:trees|landscape)|large\s+trees|wooded\s+lot|tree[\s-]?lined)\b",
    "corner_lot": r"\bcorner\s+lot\b|\bcorner\s+property\b",
}
LEVELS = {
    "view_quality": ((r"\bpanoramic\b", "panoramic"), (r"\bscenic\s+view|\bbeautiful\s+view|\bspectacular\s+view", "scenic")),
    "privacy_level": (
        (r"\bsecluded\b|\bvery\s+private\b|\bhighly\s+private\b", "secluded"),
        (r"\bprivate\s+(?:yard|property|lot|setting)\b|\bprivacy\b", "private"),
    ),
    "lot_size_indicator": (
        (r"\b(?:oversized|extra[\s-]?large|generous|expansive)\s+lot\b|\b(?:over\s+)?1\s+acre\b", "oversized"),
        (r"\b(?:large|spacious)\s+lot\b", "large"),
        (r"\b(?:small|compact)\s+lot\b", "small"),
    ),
}
LOT_COUNT = r"\b([2-9])\s+(?:adjoining|adjacent)?\s*lots?\b"
LISTED = r"(?:list(?:ed|ing)\s*(?:date|on|since)?|on\s*(?:the\s*)?market(?:\s*since)?|date\s*listed)\s*:?\s*"
YEAR = r"(1[89]\d{2}|20[012]\d)"
YEAR_RULES = (rf"\b{YEAR}\s+year\s+built\b", rf"\byear\s+built\s*[:\s]?\s*{YEAR}\b", rf"\b(?:built|constructed|erected)\s+(?:in\s+)?{YEAR}\b")
AGE_TIERS = ((1940, -6, "pre-1940"), (1960, -5, "1940-1959"), (1975, -3, "1960-1974"), (1990, -2, "1975-1989"), (2005, -1, "1990-2004"))
# Condition phrases with their points, in table order.
CONDITIONS = (
    ("new roof", 6), ("new construction", 8), ("newly built", 8), ("gut renovated", 7), ("fully renovated", 6),
    ("fully updated", 5), ("completely renovated", 6), ("recently renovated", 5), ("recently updated", 4),
    ("updated kitchen", 3), ("updated bath", 3), ("updated bathroom", 3), ("new kitchen", 4), ("new bath", 3),
    ("new bathroom", 3), ("new hvac", 4), ("new windows", 3), ("new floors", 3), ("move-in ready", 3), ("turnkey", 3),
    ("as is", -12), ("as-is", -12), ("sold as is", -15), ("needs work", -8), ("needs tlc", -8), ("tlc needed", -8),
    ("fixer", -10), ("fixer-upper", -12), ("handyman special", -12), ("cesspool", -6), ("oil heat", -4),
    ("knob and tube", -8), ("original condition", -6), ("original kitchen", -4), ("original bath", -4),
    ("deferred maintenance", -8), ("major repairs", -10), ("foundation issue", -12), ("flood zone", -5), ("flood damage", -10),
)


def _given(text: Column, value: Column) -> Column:
    return F.when(text.isNotNull() & (text != ""), value)


def garage(description: Column) -> Column:
    """struct(garage_count, garage_type)."""
    t = F.lower(description)
    at = F.regexp_instr(t, F.lit(GARAGE_COUNT))
    hit = F.regexp_extract(t, GARAGE_COUNT, 0)
    start = F.greatest(at - 31, F.lit(0))
    near = F.substring(t, start + 1, at - 1 - start + F.length(hit) + 30)
    kind = (
        F.when(near.contains("attached"), "attached")
        .when(near.contains("detached"), "detached")
        .when(near.contains("integrated"), "attached")
        .when(near.contains("enclosed") | near.contains("open") | near.contains("carport"), "detached")
    )
    whole = F.when(t.rlike(r"\battached\b|\bintegrated\b|\bbuilt[\s-]?in\b"), "attached").when(t.rlike(r"\bdetached\b|\bstandalone\b|\bseparate\b"), "detached")
    count = F.concat(*[F.regexp_extract(t, GARAGE_COUNT, g) for g in (1, 2, 3)]).try_cast("int")
    pair = lambda n, k: F.struct(n.cast("int").alias("garage_count"), k.cast("string").alias("garage_type"))
    none = F.lit(None)
    out = (
        F.when(t.rlike(NO_GARAGE), pair(F.lit(0), none))
        .when(t.rlike(r"\bcarport\b") & ~t.rlike(r"\bgarage\b"), pair(F.lit(1), F.lit("carport")))
        .when(hit != "", pair(count, kind))
        .when(t.rlike(r"\bgarage\b"), pair(F.lit(1), whole))
        .otherwise(pair(none, none))
    )
    return _given(description, out)


def hoa(description: Column) -> Column:
    """struct(hoa_monthly, hoa_annual); only the first match of each pattern counts."""
    t = F.lower(description)

    def amount(pattern: str, low: int, high: int, monthly: bool) -> Column:
        value = number(extract(t, pattern))
        good = (value >= low) & (value <= high)
        if monthly:  # the match itself, not some later one, must not go on as a yearly fee
            hit = F.regexp_extract(t, pattern, 0)
            after = F.substring(t, F.position(hit, t) + F.length(hit), F.lit(20))
            good = good & ~after.rlike("^" + YEARLY)
        return F.when(good, value)

    monthly = F.coalesce(*[amount(p, 10, 5000, True) for p in HOA_MONTHLY])
    annual = F.coalesce(*[amount(p, 100, 60000, False) for p in HOA_ANNUAL])
    none = t.rlike(NO_HOA)
    month = F.when(none, F.lit(0)).otherwise(monthly).cast("long")
    year = F.when(~none & monthly.isNull(), annual).cast("long")
    return _given(description, F.struct(month.alias("hoa_monthly"), year.alias("hoa_annual")))


def pool(description: Column) -> Column:
    t = F.lower(description)
    pair = lambda has, kind: F.struct(F.lit(has).alias("has_pool"), F.lit(kind).cast("string").alias("pool_type"))
    out = (
        F.when(t.rlike(POOL_COMMUNITY), pair(False, "community"))
        .when(t.rlike(POOL_ABOVE), pair(True, "above_ground"))
        .when(t.rlike(POOL_IN), pair(True, "inground"))
        .when(t.rlike(POOL_ANY) & ~t.rlike(POOL_NOT), pair(True, "inground"))
        .otherwise(pair(False, None))
    )
    return _given(description, out)


def basement(description: Column) -> Column:
    """struct(has_basement, basement_type, basement_gym_suitable)."""
    t = F.lower(description)
    gym = t.rlike(GYM)
    row = lambda has, kind, suits: F.struct(
        F.lit(has).cast("boolean").alias("has_basement"), F.lit(kind).cast("string").alias("basement_type"), suits.cast("boolean").alias("basement_gym_suitable")
    )
    out = (
        F.when(t.rlike(NO_BASEMENT), row(False, None, F.lit(False)))
        .when(t.rlike(WALK_OUT), row(True, "walk_out", F.lit(True)))
        .when(t.rlike(PART_FINISHED), row(True, "partially_finished", gym))
        .when(t.rlike(FINISHED), row(True, "finished", gym | ~t.rlike(CRAMPED)))
        .when(t.rlike(UNFINISHED), row(True, "unfinished", F.lit(False)))
        .when(t.rlike(BASEMENT), row(True, None, gym))
        .otherwise(row(None, None, F.lit(None)))
    )
    return _given(description, out)


def sqft_source(description: Column) -> Column:
    """struct(sqft_source, sqft_verified): the first known source over both phrasings."""
    rules = [(a, name, ok) for table, ok in ((SQFT_VERIFIED, True), (SQFT_STATED, False)) for name, aliases in table.items() for a in aliases]

    def named(raw: Column) -> Column:
        v = F.regexp_replace(F.trim(F.lower(raw)), r"\s+", " ")
        out = None
        for alias, name, _ in rules:
            test = (v == alias) | v.startswith(alias + " ")
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    raws = F.concat(*[F.regexp_extract_all(description, F.lit(p), F.lit(1)) for p in (SQFT_SOURCE, SOURCE_OF_SQFT)])
    first = F.get(F.filter(F.transform(raws, named), lambda x: x.isNotNull()), F.lit(0))
    return _given(description, F.struct(first.alias("sqft_source"), (first == "municipality").alias("sqft_verified")))


def property_type_from_text(description: Column) -> Column:
    t = F.lower(description)
    out = F.when(t.rlike(TYPE_RULES[0][0]), TYPE_RULES[0][1])
    for pattern, name in TYPE_RULES[1:]:
        out = out.when(t.rlike(pattern), name)
    return _given(description, out)


def flag(description: Column, name: str) -> Column:
    return F.coalesce(F.lower(description).rlike(FLAGS[name]), F.lit(False))


def level(description: Column, name: str) -> Column:
    t = F.lower(description)
    out = None
    for pattern, value in LEVELS[name]:
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    return out


def energy(d: Column) -> Column:
    return F.struct(*[flag(d, n).alias(n) for n in ("has_solar", "has_geothermal", "high_efficiency")])


def views(d: Column) -> Column:
    return F.struct(*[flag(d, n).alias(n) for n in ("has_water_view", "has_mountain_view", "has_city_view")], level(d, "view_quality").alias("view_quality"))


def outdoor(d: Column) -> Column:
    return F.struct(*[flag(d, n).alias(n) for n in ("has_fenced_yard", "has_patio_deck", "has_mature_trees")], level(d, "privacy_level").alias("privacy_level"))


def lot_traits(d: Column) -> Column:
    return F.struct(
        level(d, "lot_size_indicator").alias("lot_size_indicator"),
        extract(F.lower(d), LOT_COUNT).try_cast("int").alias("lot_count"),
        flag(d, "corner_lot").alias("corner_lot"),
    )


def list_date(d: Column) -> Column:
    t = F.lower(d)
    iso = extract(t, LISTED + r"(\d{4}-\d{2}-\d{2})")
    slashed = F.regexp_replace(extract(t, LISTED + r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"), "-", "/")
    worded = F.initcap(F.regexp_replace(extract(t, LISTED + r"([a-z]+\s+\d{1,2},?\s+\d{4})"), r"[,\s]+", " "))
    day = lambda x, fmt: F.date_format(F.try_to_timestamp(x, F.lit(fmt)), "yyyy-MM-dd")
    worded_day = F.when(F.length(F.substring_index(worded, " ", 1)) == 3, day(worded, "MMM d yyyy")).otherwise(day(worded, "MMMM d yyyy"))
    return F.coalesce(iso, day(slashed, "M/d/yyyy"), day(slashed, "d/M/yyyy"), F.when(worded.rlike("^[A-Z][a-z]{2,8} "), worded_day))


def year_built(d: Column) -> Column:
    t = F.lower(d)
    one, two, three = (extract(t, p).try_cast("long") for p in YEAR_RULES)
    return F.coalesce(one, two, F.when(three <= 2025, three))


def age_condition(year: Column, description: Column) -> Column:
    """struct(age_adjustment, age_tier, condition_adjustment, keywords_matched)."""
    points, tier = F.when(year.isNull(), 0), F.when(year.isNull(), "unknown")
    for below, p, name in AGE_TIERS:
        points, tier = points.when(year < below, p), tier.when(year < below, name)
    t = F.lower(F.coalesce(description, F.lit("")))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in CONDITIONS])
    hits = F.filter(table, lambda x: F.contains(t, x["k"]))
    total = F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["p"])
    return F.struct(
        points.otherwise(0).alias("age_adjustment"),
        tier.otherwise("2005+").alias("age_tier"),
        F.greatest(F.lit(-12), F.least(F.lit(6), total)).alias("condition_adjustment"),
        F.transform(hits, lambda x: x["k"]).alias("keywords_matched"),
    )


def with_description_features(df: DataFrame, description: str = "description", year: str = "year_built") -> DataFrame:
    d = F.col(description)
    built = F.col(year) if year in df.columns else F.lit(None).cast("long")
    return df.withColumns(
        {
            "garage": garage(d), "hoa": hoa(d), "pool": pool(d), "basement": basement(d), "sqft_provenance": sqft_source(d),
            "inferred_type": property_type_from_text(d), "energy": energy(d), "views": views(d), "outdoor": outdoor(d),
            "lot_traits": lot_traits(d), "list_date": list_date(d), "text_year_built": year_built(d), "age_condition": age_condition(built, d),
        }
    )


#: Letters of which a text holds one if it has the feature; looking for them is much less work than its pattern.
TELLS = {
    "has_solar": ("solar",), "has_geothermal": ("thermal",), "high_efficiency": ("effici", "energy", "systems"), "has_water_view": ("view", "water"),
    "has_mountain_view": ("view", "mountain", "hills"), "has_city_view": ("view", "skyline"), "has_fenced_yard": ("fenc",),
    "has_patio_deck": ("patio", "deck", "terrace", "porch", "pergola"), "has_mature_trees": ("tree", "landscap", "wooded"), "corner_lot": ("corner",),
    "has_pool": ("pool",), "has_basement": ("basement", "lower", "downstairs", "below", "subterranean"), "year_built": ("built", "constructed", "erected"), "list_date": ("list", "market"),
}


def feature_bits(text: Column) -> Column:
    """The features of TELLS that a lower-cased text has, as bits in that order; 0 for null."""
    found = {n: text.rlike(p) for n, p in FLAGS.items()}
    found |= {"has_pool": pool(text)["has_pool"], "has_basement": basement(text)["has_basement"], "year_built": year_built(text).isNotNull(), "list_date": list_date(text).isNotNull()}
    bits = F.lit(0)
    for k, (name, tells) in enumerate(TELLS.items()):
        may = F.lit(False)
        for x in tells:
            may = may | text.contains(x)
        bits = bits.bitwiseOR(F.when(F.coalesce(may & found[name], F.lit(False)), 1 << k).otherwise(0))
    return bits


def feature_prevalence(df: DataFrame, by: str, description: str = "description") -> DataFrame:
    """(by, feature, share): the share of rows with each feature, in long form.

    A text is lower-cased once and becomes one number of bits; its patterns are tried only
    where its letters leave them possible.
    """
    rows = df.select(by, F.lower(description).alias("__text")).select(by, feature_bits(F.col("__text")).alias("__bits"))
    share = lambda k: F.avg(F.shiftright("__bits", k).bitwiseAND(F.lit(1)))
    wide = rows.groupBy(by).agg(*[share(k).alias(n) for k, n in enumerate(TELLS)])
    return wide.unpivot([by], list(TELLS), "feature", "share")
