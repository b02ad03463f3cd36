"""Gates, score validation and auditing, and scoring plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.config import DEFAULT, Config
from listingspark.functions import text as T

HARD = "array<struct<criterion:string,passed:boolean,value:string,reason:string>>"
PLAIN_METHODS = ("ai", "deterministic-gate")


def gates(cfg: Config = DEFAULT) -> list[tuple[str, Column, Column]]:
    """(criterion, fails, value) in the order in which they are tested; null never fails."""
    s = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    no = lambda c: F.coalesce(c, F.lit(False))
    text = lambda c: F.col(c).cast("string")
    return [
        ("status", s("listing_status").isin("sold", "closed"), text("listing_status")),
        ("commute", no(F.col("commute_minutes") >= cfg.max_commute), text("commute_minutes")),
        ("state", (s("state") != "") & ~s("state").isin(*cfg.states), text("state")),
        ("price", no((F.col("price") < cfg.min_price) | (F.col("price") > cfg.max_price)), text("price")),
        ("sqft", no((F.col("sqft") > 0) & (F.col("sqft") < cfg.min_sqft)), text("sqft")),
        ("bedrooms", no((F.col("bedrooms") > 0) & (F.col("bedrooms") < cfg.min_bedrooms)), text("bedrooms")),
    ]


def hard_gate(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds gate, the first failing criterion with its value, null where all pass."""
    tests = [F.when(fails, F.struct(F.lit(name).alias("criterion"), value.alias("value"), F.concat(F.lit(f"{name} out of bounds: "), value).alias("reason"))) for name, fails, value in gates(cfg)]
    return df.withColumn("gate", F.coalesce(*tests))


def gate_result(df: DataFrame) -> DataFrame:
    """The score rows of gated listings: score 0, Reject, high confidence."""
    gated = df.filter("gate is not null")
    return gated.select("listing_id", F.lit(0).cast("long").alias("score"), F.lit("Reject").alias("verdict"), F.lit("high").alias("confidence"), F.lit("deterministic-gate").alias("evaluation_method"), F.col("gate.criterion").alias("criterion"))


def gate_summary(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(criterion, n_first, n_any): listings a criterion stops first, and that it would stop."""
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails, _ in gates(cfg)]))
    rows = df.select(F.posexplode(failed).alias("k", "criterion"))
    return rows.groupBy("criterion").agg(F.count_if(F.col("k") == 0).alias("n_first"), F.count("*").alias("n_any"))


def verdict_for_score(score: Column) -> Column:
    return F.when(score >= 80, "Strong Match").when(score >= 60, "Worth Touring").when(score >= 40, "Low Priority").otherwise("Weak Match")


VERDICTS = ("Strong Match", "Worth Touring", "Low Priority", "Weak Match", "Reject")


def validate_scores(raw: DataFrame) -> DataFrame:
    """Model output (score, verdict, hard_results, soft_points, concerns, confidence) made sound.

    Scores are whole numbers of 0 to 100; a Reject keeps its score as pre_reject_score and
    scores 0; any other verdict follows the score, but for a score of 0, which keeps a
    known one. A failed result of a verdict other than Reject becomes unknown and is
    noted once among the concerns.
    """
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("score").cast("string").try_cast("double").cast("int"), F.lit(0))))
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("Weak Match")
    reject = known == "Reject"
    verdict = F.when(reject | (score == 0), known).otherwise(verdict_for_score(score))
    hard = F.coalesce(F.col("hard_results"), F.array().cast(HARD))
    demoted = F.transform(hard, lambda x: F.when(~reject & (x["passed"] == F.lit(False)), x.withField("passed", F.lit(None).cast("boolean"))).otherwise(x))
    notes = F.transform(F.filter(hard, lambda x: ~reject & F.coalesce(x["passed"] == F.lit(False), F.lit(False))), lambda x: F.concat_ws(": ", x["criterion"], x["reason"]))
    concerns = F.filter(F.coalesce(F.col("concerns"), F.array().cast("array<string>")), lambda x: ~T.blank(F.trim(x)))
    points = F.map_filter(F.transform_values(F.col("soft_points"), lambda k, v: v.try_cast("double").cast("int")), lambda k, v: v.isNotNull())
    return raw.select(
        "listing_id",
        F.when(reject, 0).otherwise(score).cast("long").alias("score"),
        verdict.alias("verdict"),
        F.when(reject, score).cast("long").alias("pre_reject_score"),
        demoted.alias("hard_results"),
        F.coalesce(points, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).alias("soft_points"),
        F.array_distinct(F.concat(concerns, notes)).alias("concerns"),
        F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium").alias("confidence"),
    )


def parsed(scores: DataFrame) -> DataFrame:
    """JSON columns of a score table as typed ones, malformed text as null; the rest as it is."""
    return scores.withColumns(
        {
            "hard_results": F.coalesce(F.from_json("hard_results_json", HARD), F.array().cast(HARD)),
            "soft_points": F.from_json("soft_points_json", "map<string,int>"),
            "concerns": F.coalesce(F.from_json("concerns_json", "array<string>"), F.array().cast("array<string>")),
        }
    )


def implied_score(points: Column, base: int = DEFAULT.base_score) -> Column:
    total = F.aggregate(F.map_values(points), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when(points.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.lit(base) + total)).cast("long"))


def score_delta(score: Column, verdict: Column, points: Column) -> Column:
    usable = (verdict != "Reject") & (F.size(F.map_keys(points)) > 0)
    return F.when(usable, score - implied_score(points))


def reconcile_arithmetic(df: DataFrame, tolerance: int = DEFAULT.arithmetic_tolerance) -> DataFrame:
    """Notes scores that their ledger does not add up to, and lowers high confidence."""
    d = score_delta(F.col("score"), F.col("verdict"), F.col("soft_points"))
    off = F.coalesce(F.abs(d) > tolerance, F.lit(False))
    note = F.concat(F.lit("Score differs from its ledger by "), d.cast("string"))
    return df.withColumns(
        {
            "delta": d,
            "concerns": F.when(off, F.concat("concerns", F.array(note))).otherwise(F.col("concerns")),
            "confidence": F.when(off & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")),
        }
    )


# Criteria that a row's own data can bear out.
SCHOOL_NAMES = r"(?i)school|district|elementary|middle|high school"
SOLD_NAMES = r"(?i)sold|status|off.market|closed"
DETACHED_NAMES = r"(?i)detached|single.family|property type"
NOT_DETACHED = r"(?i)condo|co-?op|town|multi|attached|apartment"


def validated_failure(result: Column, best_school: Column, status: Column, property_type: Column) -> Column:
    """Whether the row's own data bear out a failed result; criteria are tested in this order."""
    name = F.coalesce(result["criterion"], F.lit(""))
    out = (
        F.when(name.rlike(SCHOOL_NAMES), best_school < DEFAULT.school_floor)
        .when(name.rlike(SOLD_NAMES), F.lower(F.trim(status)).isin("sold", "closed"))
        .when(name.rlike(DETACHED_NAMES), property_type.rlike(NOT_DETACHED))
        .otherwise(False)
    )
    return F.coalesce(out, F.lit(False))


def _failed(x: Column) -> Column:
    return F.coalesce(x["passed"] == F.lit(False), F.lit(False))


def invalid_reject(df: DataFrame) -> DataFrame:
    """Adds invalid_reject: a Reject that the gate does not bear out and no validated failure does."""
    ok = lambda x: _failed(x) & validated_failure(x, F.col("best_school"), F.col("listing_status"), F.col("property_type"))
    bad = (F.col("verdict") == "Reject") & F.col("gate").isNull() & ~F.exists("hard_results", ok)
    return df.withColumn("invalid_reject", F.coalesce(bad, F.lit(False)))


def strip_invalid_reject(df: DataFrame) -> DataFrame:
    """Restores the score and verdict of invalid rejects and drops their unproven failures."""
    bad = F.col("invalid_reject")
    score = F.coalesce("pre_reject_score", F.lit(0).cast("long"))
    keep = lambda x: ~_failed(x) | validated_failure(x, F.col("best_school"), F.col("listing_status"), F.col("property_type"))
    return df.withColumns(
        {
            "score": F.when(bad, score).otherwise(F.col("score")),
            "verdict": F.when(bad, verdict_for_score(score)).otherwise(F.col("verdict")),
            "hard_results": F.when(bad, F.filter("hard_results", keep)).otherwise(F.col("hard_results")),
            "concerns": F.when(bad, F.concat("concerns", F.array(F.lit("Rejection not supported by the listing's data")))).otherwise(F.col("concerns")),
            "confidence": F.when(bad, "low").otherwise(F.col("confidence")),
        }
    )


UNSURE_KEY = r"(?i)unknown|unconfirm|missing|unverified|unclear"


def uncertainty_penalty(points: Column, images: Column, description: Column) -> Column:
    """Sum of negative points for things unknown, where there is neither image nor text to know by."""
    unsure = F.map_filter(points, lambda k, v: k.rlike(UNSURE_KEY) & (v < 0))
    total = F.aggregate(F.map_values(unsure), F.lit(0), lambda acc, x: acc + x)
    return F.when((F.coalesce(images, F.lit(0)) == 0) & T.blank(description), F.coalesce(total, F.lit(0))).otherwise(0)


# Fixed value: reasons that own up to a penalty or a pass.
ADMITS = (
    r"(?i)[-−]\s*\d+\s*(?:point|pt)s?\b[^.]{0,40}penalt|penalt\w*[^.]{0,25}[-−]?\d+\s*(?:point|pt)"
    r"|\bnot\s+(?:actually\s+|really\s+)?a\s+(?:hard\s+)?fail|\btechnically\s+(?:passes|meets|satisfies|clears)\b"
)


def self_contradictions(df: DataFrame) -> DataFrame:
    """(listing_id, criterion, reason) of failed results whose reason speaks of a penalty or a pass."""
    rows = df.select("listing_id", F.explode("hard_results").alias("x"))
    return rows.filter(_failed(F.col("x")) & F.col("x.reason").rlike(ADMITS)).select("listing_id", "x.criterion", "x.reason")


def scoring_integrity(df: DataFrame, tolerance: int = DEFAULT.arithmetic_tolerance) -> DataFrame:
    """One row of audit figures over a parsed score table."""
    d = score_delta(F.col("score"), F.col("verdict"), F.col("soft_points"))
    contra = F.exists("hard_results", lambda x: _failed(x) & x["reason"].rlike(ADMITS))
    keys = F.map_keys("soft_points")
    school = F.size(F.filter(keys, lambda k: k.contains("school"))) >= 2
    unsure = F.exists(keys, lambda k: k.rlike(UNSURE_KEY))
    out = df.select(d.alias("d"), contra.alias("c"), F.coalesce(school, F.lit(False)).alias("s"), F.coalesce(unsure, F.lit(False)).alias("u"))
    return out.agg(
        F.count("*").alias("scored"),
        F.count_if("c").alias("contradictions"),
        F.round(F.count_if("c") / F.count("*"), 4).alias("contradiction_rate"),
        F.expr("percentile_disc(0.5) within group (order by d desc)").alias("upper_median_delta"),
        F.count_if(F.abs("d") <= tolerance).alias("within_tolerance"),
        F.count_if(F.abs("d") > tolerance).alias("breaches"),
        F.count_if("s").alias("two_school_keys"),
        F.count_if("u").alias("uncertainty_keys"),
    )


def worst_breaches(df: DataFrame, tolerance: int = DEFAULT.arithmetic_tolerance, n: int = 25) -> DataFrame:
    d = score_delta(F.col("score"), F.col("verdict"), F.col("soft_points"))
    return df.select("listing_id", d.alias("delta")).filter(F.abs("delta") > tolerance).orderBy(F.abs("delta").desc(), "listing_id").limit(n)


# How the criteria's text states each threshold, and which group holds it.
COMMUTE_LIMIT = r"(?i)commute[^.\n]{0,60}?(?:over|of)\s+(\d{2,3})\s*min|reject\s+(?:over|at)\s+(\d{2,3})\s*min"
PRICE_BAND = r"(?i)price\s+between\s+\$?([\d,]+)\s*(?:and|-|–|to)\s*\$?([\d,]+)"
THRESHOLDS = {
    "price_min": (PRICE_BAND, 1),
    "price_max": (PRICE_BAND, 2),
    "sqft": (r"(?i)minimum\s+([\d,]{3,})\s*sq\.?\s?ft", 1),
    "bedrooms": (r"(?i)minimum\s+(\d{1,2})\s+bedrooms?", 1),
    "school_floor": (r"(?i)below\s+(\d{1,2})(?:st|nd|rd|th)\s+percentile", 1),
    "base": (r"(?i)base\s+score:?\s*(\d{1,3})", 1),
}


def criteria_thresholds(df: DataFrame) -> DataFrame:
    """Each threshold that the criteria's text states, by its first match; null where it states none."""
    text = F.col("instructions")
    # the first match in the text, whichever form it has: one group or the other is blank
    commute = T.number(F.coalesce(F.nullif(T.extract(text, COMMUTE_LIMIT, 1), F.lit("")), T.extract(text, COMMUTE_LIMIT, 2)))
    return df.select("version", commute.alias("commute"), *[T.number(T.extract(text, p, g)).alias(n) for n, (p, g) in THRESHOLDS.items()])


def gate_drift(criteria: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(version, check, stated, configured, in_sync): what the criteria's text says against the config."""
    configured = {"commute": cfg.max_commute, "price_min": cfg.min_price, "price_max": cfg.max_price, "sqft": cfg.min_sqft, "bedrooms": cfg.min_bedrooms, "school_floor": int(cfg.school_floor), "base": cfg.base_score}
    rows = criteria_thresholds(criteria).unpivot(["version"], list(configured), "check", "stated")
    table = F.create_map(*[F.lit(x) for kv in configured.items() for x in kv])
    rows = rows.withColumn("configured", table[F.col("check")].cast("long"))
    return rows.withColumn("in_sync", F.col("stated").isNull() | (F.col("stated") == F.col("configured")))


def input_fingerprint(columns: list[str]) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 32)


def needs_score(listings: DataFrame, scores: DataFrame, version: int, cfg: Config = DEFAULT) -> DataFrame:
    """(listing_id, reasons) of listings that must be scored again, with every reason why."""
    s = scores.select("listing_id", F.col("verdict").alias("__verdict"), F.col("evaluation_method").alias("__method"), F.col("criteria_version").alias("__version"), F.col("input_fingerprint").alias("__print"), F.lit(True).alias("__scored"))
    out = hard_gate(listings, cfg).join(s, "listing_id", "left")
    has = F.col("__scored").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~has, "no_score"),
            F.when(has & ~F.coalesce(F.col("__method").isin(*PLAIN_METHODS), F.lit(False)), "method"),
            F.when(has & ~F.col("__version").eqNullSafe(F.lit(version)), "version"),
            F.when(has & ~F.col("__print").eqNullSafe(F.col("fingerprint")), "fingerprint"),
            F.when(has & (F.col("__verdict") != "Reject") & F.col("gate").isNotNull(), "gate"),
        )
    )
    return out.select("listing_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def should_skip(version: int) -> Column:
    fresh = (F.col("criteria_version") == version) & (F.col("evaluation_method") != "ai_failed") & F.col("scored_at").isNotNull()
    stale = F.coalesce(F.col("enriched_at") > F.col("scored_at"), F.lit(False))
    return F.coalesce(fresh & ~stale, F.lit(False))


def rescore_plan(listings: DataFrame, scores: DataFrame, version: int, cfg: Config = DEFAULT) -> DataFrame:
    """One row: total, skipped, gated (no model needed) and to_score."""
    out = hard_gate(listings, cfg).join(scores.select("listing_id", should_skip(version).alias("skip")), "listing_id", "left")
    skip = F.coalesce("skip", F.lit(False))
    return out.agg(
        F.count("*").alias("total"),
        F.count_if(skip).alias("skipped"),
        F.count_if(~skip & F.col("gate").isNotNull()).alias("gated"),
        F.count_if(~skip & F.col("gate").isNull()).alias("to_score"),
    )


#: What enrichment adds to a payload, by its part; parts without any value are left out.
ENRICHED = {
    "schools": ("schools",),
    "commute": ("commute_minutes", "commute_rejected"),
    "price_per_sqft": ("ppsf", "benchmark", "ratio", "signal"),
    "tax": ("assessed", "market", "tier"),
    "lot": ("lot_acres",),
    "power": ("n_features", "nearest_m"),
    "flood": ("zone", "sfha"),
    "station": ("station", "station_m", "walk_min"),
}


def build_scoring_payload(df: DataFrame) -> DataFrame:
    """(listing_id, payload): the nested request of a listing, as JSON.

    Base fields, size source, inferred type and age come first, then the description's
    features that say anything, then what ``enrich_all`` found, as far as ``df`` has its
    columns, then the evidence: images, where there is such a column, and description.
    """
    from listingspark.functions.features import with_description_features

    rich = with_description_features(df)
    usable = lambda c: F.when(F.size(F.filter(F.array(*[F.col(f"{c}.{n}").cast("string") for n in rich.schema[c].dataType.names]), lambda x: x.isNotNull() & (x != "false"))) > 0, F.col(c))
    parts = {name: [c for c in columns if c in df.columns] for name, columns in ENRICHED.items()}
    found = [F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull(), F.struct(*columns)).alias(name) for name, columns in parts.items() if columns]
    payload = F.struct(
        *[F.col(c) for c in ("address", "town", "state", "price", "sqft", "bedrooms", "year_built")],
        "sqft_provenance", "inferred_type", "age_condition",
        *[usable(c).alias(c) for c in ("garage", "hoa", "pool", "basement", "energy", "views", "outdoor", "lot_traits")],
        *found,
        F.struct(*[c for c in ("images", "description") if c in df.columns]).alias("evidence"),
    )
    return rich.select("listing_id", F.to_json(payload).alias("payload"))


def apply_scores(requests: DataFrame, responses: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(valid score rows, requests to retry): responses are JSON text by listing_id.

    A response is validated, then stripped of a Reject that neither the gate nor its own
    validated failures bear out, then reconciled with its ledger. ``requests`` holds the
    listings' gate columns, best_school and property_type. Of several responses to a request
    the greatest as text counts.
    """
    responses = responses.groupBy("listing_id").agg(F.max("response").alias("response"))
    schema = f"score string, verdict string, hard_results {HARD}, soft_points map<string,string>, concerns array<string>, confidence string"
    read = requests.select("listing_id").join(responses, "listing_id", "left").withColumn("r", F.from_json(T.strip_json_fence(F.col("response")), schema))
    good = validate_scores(read.filter(F.col("r.verdict").isNotNull()).select("listing_id", "r.*"))
    facts = hard_gate(requests, cfg).select("listing_id", "gate", "best_school", "listing_status", "property_type")
    stripped = strip_invalid_reject(invalid_reject(good.join(facts, "listing_id")))
    kept = reconcile_arithmetic(stripped).drop("gate", "best_school", "listing_status", "property_type")
    return kept, read.filter(F.col("r.verdict").isNull()).select("listing_id")


def ledger_score(df: DataFrame, rules: DataFrame, base: int = DEFAULT.base_score) -> DataFrame:
    """Points of each (listing_id, factor, value) by the rules' bands (factor, lo, hi, points).

    The rules are a configuration table; the join is an equi join on the factor with the
    band as a residual test.
    """
    hits = df.join(rules, "factor").filter("value >= lo and value < hi")
    out = hits.groupBy("listing_id").agg(F.sum("points").alias("sum_points"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "points")))).alias("ledger"))
    return out.withColumn("ledger_score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(base) + F.col("sum_points"))).cast("long"))


def active_criteria(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.max("version").alias("version"), F.max_by("instructions", "version").alias("instructions"))


def criteria_history(df: DataFrame) -> DataFrame:
    return df.select("version", "created_by", F.left("instructions", F.lit(80)).alias("preview")).orderBy(F.col("version").desc())


def next_version(df: DataFrame) -> DataFrame:
    return df.groupBy().agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def batch_chunks(df: DataFrame, n: int = 5, parts: int = 16) -> DataFrame:
    """Deterministic chunk ids (part, chunk) of at most ``n`` rows, without a global order."""
    from pyspark.sql import Window

    out = df.withColumn("part", F.pmod("listing_id", F.lit(parts)))
    rn = F.row_number().over(Window.partitionBy("part").orderBy("listing_id"))
    return out.select("listing_id", "part", F.floor((rn - 1) / n).alias("chunk"))
