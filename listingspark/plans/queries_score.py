"""Queries of gates, score audits, plans and tasks, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators import enrich, resolve, tasks
from listingspark.operators import score as C
from listingspark.plans import sqltext as S
from listingspark.registry import query

L = ["listings_v"]
LS = ["listings_v", "scores_v"]


@query(
    "flagship",
    ["listings_v", "stations_v"],
    f""", keyed as (select *, {S.address_key()} as address_key from listings_v), ok as (select * from keyed where {S.gate_criterion()} is null and ({S.status_class('listing_status')}) in ('live_market', 'live_event')),
    r as (select *, row_number() over (partition by address_key order by coalesce(toured, false)::int desc, (coalesce(mls_id, '') <> '')::int desc, (coalesce(listing_url, '') <> '')::int desc, listing_id) as rn from ok),
    d as (select k.listing_id, k.address_key, k.score, s.name, s.idx, {S.haversine('k.lat', 'k.lng', 's.lat', 's.lng')} as m from r k cross join stations_v s where k.rn = 1),
    n as (select *, row_number() over (partition by listing_id order by m, idx) as q from d)
    select listing_id, address_key, score, name as station, cast(round(m) as bigint) as station_m from n where q = 1 order by score desc, listing_id limit 50""",
)
def _(v):
    rows = C.hard_gate(resolve.with_keys(v("listings_v"))).filter(F.col("gate").isNull() & T.is_live(F.col("listing_status")))
    best = resolve.dedup_by_address_key(rows).orderBy(F.col("score").desc(), "listing_id").limit(50)
    return enrich.nearest_station(best, v("stations_v")).select("listing_id", "address_key", "score", "station", "station_m")


@query("f01_status_class", L, f"select listing_id, {S.status_class('listing_status')} as class from listings_v")
def _(v):
    return v("listings_v").select("listing_id", T.status_class(F.col("listing_status")).alias("class"))


@query("f02_hard_gate", L, f"select listing_id, {S.gate_criterion()} as criterion, {S.gate_value()} as value from listings_v where {S.gate_criterion()} is not null")
def _(v):
    return C.hard_gate(v("listings_v")).filter("gate is not null").select("listing_id", "gate.criterion", "gate.value")


@query(
    "f03_gate_summary",
    L,
    ", x as (" + " union all ".join(f"select '{n}' as criterion, ({S.gate_criterion()}) = '{n}' as first from listings_v where {t}" for n, t, _ in S.gates()) + ") select criterion, count(*) filter (first) as n_first, count(*) as n_any from x group by 1",
)
def _(v):
    return C.gate_summary(v("listings_v"))


@query("f04_verdict", ["scores_v"], "select listing_id, case when score >= 80 then 'Strong Match' when score >= 60 then 'Worth Touring' when score >= 40 then 'Low Priority' else 'Weak Match' end as verdict from scores_v")
def _(v):
    return v("scores_v").select("listing_id", C.verdict_for_score(F.col("score")).alias("verdict"))


@query("f05_validate_scores", ["scores_v"], f""", {S.PARSED}, raw as (select *, score * 2 - 40 as rawscore from parsed), c as (select *, cast(greatest(0, least(100, rawscore)) as bigint) as s from raw)
    select listing_id, case when verdict = 'Reject' then 0 else s end as score, case when verdict = 'Reject' or s = 0 then verdict when s >= 80 then 'Strong Match' when s >= 60 then 'Worth Touring' when s >= 40 then 'Low Priority' else 'Weak Match' end as verdict,
      case when verdict = 'Reject' then s end as pre_reject_score, len(list_filter(hard_results, lambda x: x.passed is null)) + case when verdict <> 'Reject' then len(list_filter(hard_results, lambda x: x.passed = false)) else 0 end as n_unknown,
      len(concerns) + case when verdict <> 'Reject' then len(list_filter(hard_results, lambda x: x.passed = false)) else 0 end as n_concerns, confidence from c""")
def _(v):
    p = C.parsed(v("scores_v")).withColumn("score", (F.col("score") * 2 - 40).cast("string")).withColumn("soft_points", F.transform_values("soft_points", lambda k, x: x.cast("string")))
    return C.validate_scores(p).select("listing_id", "score", "verdict", "pre_reject_score", F.size(F.filter("hard_results", lambda x: x["passed"].isNull())).alias("n_unknown"), F.size("concerns").alias("n_concerns"), "confidence")


@query("f08_score_delta", ["scores_v"], f", {S.PARSED} select listing_id, case when soft_points_json is not null then {S.IMPLIED} end as implied, {S.DELTA} as delta from parsed")
def _(v):
    p = C.parsed(v("scores_v"))
    return p.select("listing_id", C.implied_score(F.col("soft_points")).alias("implied"), C.score_delta(F.col("score"), F.col("verdict"), F.col("soft_points")).alias("delta"))


@query("f09_reconcile_arithmetic", ["scores_v"], f", {S.PARSED}, d as (select *, {S.DELTA} as delta from parsed) select listing_id, delta, len(concerns) + coalesce(abs(delta) > 5, false)::int as n_concerns, case when coalesce(abs(delta) > 5, false) and confidence = 'high' then 'medium' else confidence end as confidence from d")
def _(v):
    return C.reconcile_arithmetic(C.parsed(v("scores_v"))).select("listing_id", "delta", F.size("concerns").alias("n_concerns"), "confidence")


PROPERTY = "case listing_id % 3 when 0 then 'Condo' when 1 then 'Single Family' end"
REJ = f""", {S.PARSED}, j as (select p.*, l.listing_status, {S.gate_criterion()} as gate, cast(l.listing_id % 70 + 20 as double) as best_school, l.property_type from parsed p join (select *, {PROPERTY} as property_type from listings_v) l using (listing_id)),
    b as (select *, verdict = 'Reject' and gate is null and not coalesce(len(list_filter(hard_results, lambda x: x.passed = false and (case when contains(lower(x.criterion), 'school') then best_school < 50
      when contains(lower(x.criterion), 'sold') or contains(lower(x.criterion), 'status') then lower(trim(listing_status)) in ('sold', 'closed') when contains(lower(x.criterion), 'detached') then property_type = 'Condo' else false end))) > 0, false) as invalid_reject from j)"""


def _facts(v):
    return v("listings_v").withColumns({"best_school": (F.col("listing_id") % 70 + 20).cast("double"), "property_type": F.expr(PROPERTY)})


def _rejects(v):
    rows = C.hard_gate(_facts(v)).select("listing_id", "listing_status", "gate", "best_school", "property_type")
    p = C.parsed(v("scores_v")).withColumn("pre_reject_score", F.col("score"))
    return C.invalid_reject(p.join(rows, "listing_id"))


@query("f11_invalid_reject", LS, REJ + " select listing_id, invalid_reject from b where verdict = 'Reject'")
def _(v):
    return _rejects(v).filter("verdict = 'Reject'").select("listing_id", "invalid_reject")


@query("f12_strip_invalid_reject", LS, REJ + " select listing_id, score, case when invalid_reject then case when score >= 80 then 'Strong Match' when score >= 60 then 'Worth Touring' when score >= 40 then 'Low Priority' else 'Weak Match' end else verdict end as verdict, case when invalid_reject then 'low' else confidence end as confidence, len(concerns) + invalid_reject::int as n_concerns from b where verdict = 'Reject'")
def _(v):
    bad = _rejects(v).filter("verdict = 'Reject'")
    return C.strip_invalid_reject(bad).select("listing_id", "score", "verdict", "confidence", F.size("concerns").alias("n_concerns"))


@query("f13_uncertainty_penalty", ["scores_v"], f", {S.PARSED} select listing_id, case when listing_id % 2 = 0 then coalesce(case when p3 < 0 then p3 end, 0) else 0 end as penalty from parsed")
def _(v):
    p = C.parsed(v("scores_v"))
    return p.select("listing_id", C.uncertainty_penalty(F.col("soft_points"), F.col("listing_id") % 2, F.lit("")).cast("long").alias("penalty"))


@query("f14_self_contradictions", ["scores_v"], f", {S.PARSED}, x as (select listing_id, unnest(hard_results) as h from parsed) select listing_id, h.criterion as criterion, h.reason as reason from x where h.passed = false and regexp_matches(h.reason, '{C.ADMITS}')")
def _(v):
    return C.self_contradictions(C.parsed(v("scores_v")))


@query(
    "f15_scoring_integrity",
    ["scores_v"],
    f""", {S.PARSED}, d as (select *, {S.DELTA} as d, len(list_filter(hard_results, lambda x: x.passed = false and regexp_matches(x.reason, '{C.ADMITS}'))) > 0 as c from parsed)
    select count(*) as scored, count(*) filter (c) as contradictions, round(count(*) filter (c) / count(*), 4) as contradiction_rate, percentile_disc(0.5) within group (order by d desc) as upper_median_delta,
      count(*) filter (abs(d) <= 5) as within_tolerance, count(*) filter (abs(d) > 5) as breaches, cast(0 as bigint) as two_school_keys, count(soft_points_json) as uncertainty_keys from d""",
)
def _(v):
    return C.scoring_integrity(C.parsed(v("scores_v")))


@query("f15_worst_breaches", ["scores_v"], f", {S.PARSED}, d as (select listing_id, {S.DELTA} as delta from parsed) select * from d where abs(delta) > 5 order by abs(delta) desc, listing_id limit 25")
def _(v):
    return C.worst_breaches(C.parsed(v("scores_v")))


@query(
    "f17_gate_drift",
    ["criteria_v"],
    ", t as (select version, " + ", ".join(f"replace({x}, ',', '') as {n}" for n, x in S.thresholds().items()) + r""" from criteria_v),
    x as (select version, 'commute' as "check", commute as s, 110 as configured from t union all select version, 'price_min', price_min, 850000 from t union all select version, 'price_max', price_max, 2250000 from t
      union all select version, 'sqft', sqft, 2200 from t union all select version, 'bedrooms', bedrooms, 3 from t union all select version, 'school_floor', school_floor, 50 from t union all select version, 'base', base, 50 from t)
    select version, "check", try_cast(nullif(s, '') as bigint) as stated, cast(configured as bigint) as configured, coalesce(try_cast(nullif(s, '') as bigint) = configured, true) as in_sync from x""",
)
def _(v):
    return C.gate_drift(v("criteria_v"))


@query("f18_input_fingerprint", L, None)
def _(v):
    return v("listings_v").select("listing_id", C.input_fingerprint(["address", "town", "price", "sqft", "description"]).alias("fingerprint"))


NEEDS = f""", j as (select l.*, s.verdict, s.evaluation_method, s.criteria_version as cv, s.input_fingerprint, s.listing_id as sid, {S.gate_criterion()} as gate from listings_v l left join (select * from scores_v where listing_id % 11 <> 0) s using (listing_id)),
    n as (select listing_id, concat_ws(',', case when sid is null then 'no_score' end, case when sid is not null and coalesce(evaluation_method, '') not in ('ai', 'deterministic-gate') then 'method' end,
      case when sid is not null and cv is distinct from 77 then 'version' end, case when sid is not null and input_fingerprint is distinct from cast(listing_id % 1000 as varchar) then 'fingerprint' end,
      case when sid is not null and verdict <> 'Reject' and gate is not null then 'gate' end) as reasons from j)"""


def _fingered(v):
    return v("listings_v").withColumn("fingerprint", (F.col("listing_id") % 1000).cast("string"))


@query("f19_needs_score", LS, NEEDS + " select * from n where reasons <> ''")
def _(v):
    return C.needs_score(_fingered(v), v("scores_v").filter("listing_id % 11 <> 0"), 77).withColumn("reasons", F.array_join("reasons", ","))


@query("f20_should_skip", ["scores_v"], "select listing_id, coalesce(criteria_version = 77 and evaluation_method <> 'ai_failed' and scored_at is not null and not coalesce(enriched_at > scored_at, false), false) as skip from scores_v")
def _(v):
    return v("scores_v").select("listing_id", C.should_skip(77).alias("skip"))


@query("f21_rescore_plan", LS, f""", j as (select l.*, coalesce(s.criteria_version = 77 and s.evaluation_method <> 'ai_failed' and not coalesce(s.enriched_at > s.scored_at, false), false) as skip from listings_v l left join scores_v s using (listing_id))
    select count(*) as total, count(*) filter (skip) as skipped, count(*) filter (not skip and {S.gate_criterion()} is not null) as gated, count(*) filter (not skip and {S.gate_criterion()} is null) as to_score from j""")
def _(v):
    return C.rescore_plan(v("listings_v"), v("scores_v"), 77)


@query("f22_scoring_payload", L, None)
def _(v):
    from listingspark.operators.enrich import enrich_all
    from listingspark.plans.queries_enrich import references

    homes = v("listings_v")
    return C.build_scoring_payload(enrich_all(homes, references(v, homes)))


@query(
    "f23_apply_scores",
    LS,
    REJ + """ select listing_id, case when verdict = 'Reject' and not invalid_reject then 0 else score end as score, case when invalid_reject then case when score >= 80 then 'Strong Match' when score >= 60 then 'Worth Touring' when score >= 40 then 'Low Priority' else 'Weak Match' end else verdict end as verdict,
      case when invalid_reject then 'low' else confidence end as confidence, case when verdict = 'Reject' then score end as pre_reject_score, 'scored' as outcome from b where listing_id % 5 <> 0 union all select listing_id, null, null, null, null, 'retry' from scores_v where listing_id % 5 = 0""",
)
def _(v):
    s = C.parsed(v("scores_v"))
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("score").cast("string").alias("score"), "verdict", "confidence", "hard_results")), F.lit("\n```"))
    responses = s.select("listing_id", F.when(F.col("listing_id") % 5 == 0, "not json").otherwise(body).alias("response"))
    good, retry = C.apply_scores(_facts(v), responses)
    rows = good.select("listing_id", "score", "verdict", "confidence", "pre_reject_score", F.lit("scored").alias("outcome"))
    return rows.unionByName(retry.withColumn("outcome", F.lit("retry")), allowMissingColumns=True)


RULES = [("commute", 0, 60, 10), ("commute", 60, 90, 0), ("commute", 90, 999, -10), ("sqft", 0, 2200, -5), ("sqft", 2200, 3000, 5), ("sqft", 3000, 99999, 8)]


@query(
    "f24_ledger_score",
    L,
    """, x as (select listing_id, case when commute_minutes < 60 then 10 when commute_minutes < 90 then 0 when commute_minutes >= 90 then -10 end as p from listings_v union all select listing_id, case when sqft < 2200 then -5 when sqft < 3000 then 5 when sqft >= 3000 then 8 end from listings_v)
    select listing_id, cast(sum(p) as bigint) as sum_points, cast(greatest(0, least(100, 50 + sum(p))) as bigint) as ledger_score from x where p is not null group by 1""",
)
def _(v):
    facts = v("listings_v").select("listing_id", F.col("commute_minutes").alias("commute"), "sqft").unpivot(["listing_id"], ["commute", "sqft"], "factor", "value")
    rules = v.spark.createDataFrame(RULES, "factor string, lo long, hi long, points long")
    return C.ledger_score(facts, rules).drop("ledger")


@query("f25_criteria_history", ["criteria_v"], "select version, created_by, left(instructions, 80) as preview, (select max(version) + 1 from criteria_v) as next_version, (select max(version) from criteria_v) as active_version, (select left(arg_max(instructions, version), 80) from criteria_v) as active_preview from criteria_v")
def _(v):
    c = v("criteria_v")
    active = C.active_criteria(c).select(F.col("version").alias("active_version"), F.left("instructions", F.lit(80)).alias("active_preview"))
    return C.criteria_history(c).join(F.broadcast(C.next_version(c))).join(F.broadcast(active))


@query("f26_batch_chunks", L, ", x as (select listing_id, listing_id % 16 as part, row_number() over (partition by listing_id % 16 order by listing_id) as rn from listings_v) select listing_id, part, cast(floor((rn - 1) / 5) as bigint) as chunk from x")
def _(v):
    return C.batch_chunks(v("listings_v"))


@query(
    "g01_gap_scan",
    LS,
    NEEDS
    + f""", g as (select l.*, n.reasons from listings_v l left join n using (listing_id)), x as (
      select listing_id, 'scrape_desc' as task from g where coalesce(description, '') = '' or listing_id % 3 = 0 union all
      select listing_id, 'stats' from g where (price is null or sqft is null or bedrooms is null or year_built is null) and (coalesce(listing_url, '') <> '' or coalesce(description, '') <> '') union all
      select listing_id, 'commute' from g where commute_minutes is null and coalesce(address, '') <> '' and coalesce(town, '') <> '' union all select listing_id, 'schools' from g where listing_id % 4 = 0 union all
      select listing_id, 'status' from g where ({S.status_class('listing_status')}) = 'unknown' union all select listing_id, 'score' from g where reasons <> '')
    select task, count(*) as n from x group by 1""",
)
def _(v):
    rows = _fingered(v).withColumns({"n_images": F.col("listing_id") % 3, "schools": F.when(F.col("listing_id") % 4 != 0, "x")})
    return tasks.gap_counts(tasks.gap_scan(rows, v("scores_v").filter("listing_id % 11 <> 0"), 77))


@query(
    "g02_ready_tasks",
    ["tasks_v"],
    """ select listing_id, task_id, task_type from tasks_v t where status = 'pending' and attempts < 3 and (task_type <> 'score' or not exists (select 1 from tasks_v o where o.listing_id = t.listing_id and o.task_type <> 'score' and (o.status = 'running' or (o.status = 'pending' and o.attempts = 0))))
    order by listing_id desc, list_position(['scrape_desc', 'stats', 'commute', 'schools', 'status', 'score'], task_type), task_id limit 500""",
)
def _(v):
    return tasks.ready_tasks(v("tasks_v"), 500).select("listing_id", "task_id", "task_type")


@query(
    "g03_requeue",
    ["tasks_v"],
    """, t as (select listing_id, task_type, arg_max(status, task_id) as status, arg_max(attempts, task_id) as attempts from tasks_v group by 1, 2), w as (select listing_id, 'stats' as task_type from t union select listing_id, 'commute' from t where listing_id % 2 = 0)
    select coalesce(t.listing_id, w.listing_id) as listing_id, coalesce(t.task_type, w.task_type) as task_type, case when t.status is null or (w.listing_id is not null and t.status in ('done', 'failed')) then 'pending' else t.status end as status,
      case when t.status is null or (w.listing_id is not null and t.status = 'done') then 0 when w.listing_id is not null and t.status = 'failed' then 2 else t.attempts end as attempts from t full join w on t.listing_id = w.listing_id and t.task_type = w.task_type""",
)
def _(v):
    t = v("tasks_v").groupBy("listing_id", "task_type").agg(F.max_by("status", "task_id").alias("status"), F.max_by("attempts", "task_id").alias("attempts"))
    wanted = t.select("listing_id", F.lit("stats").alias("task_type")).union(t.filter("listing_id % 2 = 0").select("listing_id", F.lit("commute")))
    return tasks.requeue(t, wanted)


@query("g04_task_counts", ["tasks_v"], "select task_type, status, count(*) as n, cast(grouping(task_type) as int) as all_tasks from tasks_v group by grouping sets ((status), (task_type, status))")
def _(v):
    return tasks.task_counts(v("tasks_v")).withColumn("all_tasks", F.col("all_tasks").cast("int"))
