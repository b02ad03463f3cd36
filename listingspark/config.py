"""Rule constants in one frozen place; every operator takes a Config or a column name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_commute: int = 110
    states: tuple[str, ...] = ("ny", "new york")
    min_price: int = 850_000
    max_price: int = 2_250_000
    min_sqft: int = 2200
    min_bedrooms: int = 3
    school_floor: float = 50.0
    base_score: int = 50
    alert_threshold: int = 70
    rearm_margin: int = 10
    max_age_days: int = 21
    arithmetic_tolerance: int = 5
    stale_hours: int = 25


DEFAULT = Config()

# Status vocabularies, compared in lower case without outer blanks.
MARKET_LIVE = ("active", "new listing", "coming soon", "pre on-market", "back on market")
OFF_MARKET = ("pending", "sold", "under contract", "contingent", "closed", "off market", "off market?", "sold?")
LIVE_EVENTS = ("open house", "price drop", "price decreased", "price increased")
