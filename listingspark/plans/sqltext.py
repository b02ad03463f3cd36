"""DuckDB text of the shared expressions, for the SQL twins."""

from __future__ import annotations

from listingspark.config import LIVE_EVENTS, MARKET_LIVE, OFF_MARKET
from listingspark.functions.text import DIRECTIONS, STATES, SUFFIXES


def quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def squeezed(c: str) -> str:
    return rf"regexp_replace(replace(replace(lower(trim({c})), '.', ''), '-', ' '), '\s+', ' ', 'g')"


def address_key(a: str = "address", t: str = "town", s: str = "state") -> str:
    out = squeezed(a)
    for long, short in [*SUFFIXES.items(), *sorted(DIRECTIONS.items(), key=lambda x: -len(x[0]))]:
        out = rf"regexp_replace({out}, '\b{long}\b', '{short}', 'g')"
    low = f"replace(lower(trim(coalesce({s}, ''))), '.', '')"
    code = "case " + low + " " + " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items()) + f" else {low} end"
    return f"case when {a} is not null and {a} <> '' and {t} is not null and {t} <> '' then concat({out}, '|', {squeezed(t)}, '|', {code}) end"


def home_id(u: str = "listing_url") -> str:
    return rf"nullif(regexp_extract({u}, '/home/(\d+)', 1), '')"


def status_class(c: str) -> str:
    s = f"lower(trim(coalesce({c}, '')))"
    return f"case when {s} in ({quoted(MARKET_LIVE)}) then 'live_market' when {s} in ({quoted(LIVE_EVENTS)}) then 'live_event' when {s} in ({quoted(OFF_MARKET)}) then 'off_market' else 'unknown' end"


def thresholds() -> dict[str, str]:
    """Text of each threshold of a criteria text, by the patterns that are fixed values."""
    from listingspark.operators.score import COMMUTE_LIMIT, THRESHOLDS

    commute = f"coalesce(nullif(regexp_extract(instructions, '{COMMUTE_LIMIT}', 1), ''), regexp_extract(instructions, '{COMMUTE_LIMIT}', 2))"
    return {"commute": commute} | {n: f"regexp_extract(instructions, '{p}', {g})" for n, (p, g) in THRESHOLDS.items()}


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2))))"


def gates() -> list[tuple[str, str, str]]:
    return [
        ("status", "lower(trim(coalesce(listing_status, ''))) in ('sold', 'closed')", "listing_status"),
        ("commute", "coalesce(commute_minutes >= 110, false)", "cast(commute_minutes as varchar)"),
        ("state", "lower(trim(coalesce(state, ''))) not in ('', 'ny', 'new york')", "state"),
        ("price", "coalesce(price < 850000 or price > 2250000, false)", "cast(price as varchar)"),
        ("sqft", "coalesce(sqft > 0 and sqft < 2200, false)", "cast(sqft as varchar)"),
        ("bedrooms", "coalesce(bedrooms > 0 and bedrooms < 3, false)", "cast(bedrooms as varchar)"),
    ]


def gate_criterion() -> str:
    return "case " + " ".join(f"when {t} then '{n}'" for n, t, _ in gates()) + " end"


def gate_value() -> str:
    return "case " + " ".join(f"when {t} then {v}" for _, t, v in gates()) + " end"


HARD = '\'[{"criterion":"VARCHAR","passed":"BOOLEAN","value":"VARCHAR","reason":"VARCHAR"}]\''

PARSED = f"""parsed as (
  select s.*, coalesce(from_json(hard_results_json, {HARD}), []) as hard_results, coalesce(from_json(concerns_json, '["VARCHAR"]'), []) as concerns,
    cast(json_extract(soft_points_json, '$.commute') as bigint) as p1, cast(json_extract(soft_points_json, '$.schools') as bigint) as p2, cast(json_extract(soft_points_json, '$.unknown_lot') as bigint) as p3
  from scores_v s)"""
IMPLIED = "cast(greatest(0, least(100, 50 + p1 + p2 + p3)) as bigint)"
DELTA = f"case when verdict <> 'Reject' and soft_points_json is not null then score - {IMPLIED} end"
