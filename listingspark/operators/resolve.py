"""Entity resolution: matching, deduplication and conflict-aware updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.functions import text as T


def with_keys(df: DataFrame, address: str = "address", town: str = "town", state: str = "state", url: str = "listing_url") -> DataFrame:
    return df.withColumns({"address_key": T.address_key(F.col(address), F.col(town), F.col(state)), "home_id": T.home_id(F.col(url))})


def best_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; rows without a key pass through.

    Null keys never enter the window, where they would all meet in one task.
    """
    keyed = df.filter(F.col(key).isNotNull())
    best = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")
    return best.unionByName(df.filter(F.col(key).isNull()))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").desc()


def address_order() -> list[Column]:
    has = lambda c: _yes(~T.blank(F.col(c)))
    return [_yes(F.col("toured")), has("mls_id"), has("listing_url"), F.col("listing_id")]


def home_order() -> list[Column]:
    any_flag = F.coalesce("toured", F.lit(False)) | F.coalesce("liked", F.lit(False)) | F.coalesce("passed", F.lit(False)) | F.coalesce("tour_requested", F.lit(False))
    return [_yes(any_flag), _yes(~T.blank(F.col("description"))), _yes(~T.blank(F.col("mls_id"))), F.col("listing_id")]


def dedup_by_address_key(df: DataFrame) -> DataFrame:
    return best_by(df, "address_key", address_order())


def dedup_by_home_id(df: DataFrame) -> DataFrame:
    return best_by(df, "home_id", home_order())


def dedup_report(df: DataFrame, key: str = "address_key", order: list[Column] | None = None) -> DataFrame:
    """(key, loser, survivor) for every row that a deduplication drops."""
    w = Window.partitionBy(key).orderBy(*(order or address_order()))
    kept = F.first("listing_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = df.filter(F.col(key).isNotNull()).withColumn("survivor", kept)
    return ranked.filter("listing_id <> survivor").select(key, F.col("listing_id").alias("loser"), "survivor")


def match_existing(incoming: DataFrame, listings: DataFrame, id_col: str = "incoming_id") -> DataFrame:
    """(id_col, match_id, match_tier): by MLS, then home id, then address key; not transitive.

    The smallest listing of a key is its match. Incoming rows with neither an MLS number
    nor an address are rejected with tier ``rejected``.
    """
    out = incoming
    for tier, key in (("mls", "mls_id"), ("home", "home_id"), ("address", "address_key")):
        firsts = listings.filter(~T.blank(F.col(key))).groupBy(F.col(key).alias(f"__{tier}_key")).agg(F.min("listing_id").alias(f"__{tier}"))
        out = out.join(firsts, F.nullif(F.col(key), F.lit("")) == F.col(f"__{tier}_key"), "left")
    usable = ~T.blank(F.col("mls_id")) | ~T.blank(F.col("address"))
    match = F.coalesce("__mls", "__home", "__address")
    tier = F.when(~usable, "rejected").when(F.col("__mls").isNotNull(), "mls").when(F.col("__home").isNotNull(), "home").when(F.col("__address").isNotNull(), "address")
    return out.select(id_col, F.when(usable, match).alias("match_id"), tier.otherwise("new").alias("match_tier"))


def settled_status(status: Column) -> Column:
    return F.when(F.lower(F.trim(status)).isin("sold", "closed"), "Sold?").otherwise(status)


def fold_updates(listings: DataFrame, updates: DataFrame) -> DataFrame:
    """Folds each listing's updates in time order into price, status and change flags.

    A price of 100,000 and more fills a missing one, and replaces a differing one unless
    it is more than half of it away. An event label never overwrites a market state.
    """
    kind = "struct<price:bigint,status:string,url:string,price_changes:int,direction:string,rescore:boolean>"

    def step(acc: Column, u: Column) -> Column:
        old, new = acc["price"], u["new_price"]
        fill = old.isNull() & (new >= 100_000)
        change = (old > 0) & (new >= 100_000) & (old != new) & (F.abs(new - old) <= 0.5 * old)
        fill, change = F.coalesce(fill, F.lit(False)), F.coalesce(change, F.lit(False))
        s = settled_status(u["new_status"])
        move = ~T.blank(u["new_status"]) & ~F.coalesce(F.lower(F.trim(acc["status"])) == F.lower(F.trim(u["new_status"])), F.lit(False))
        move = move & ~F.coalesce(~T.is_market_state(u["new_status"]) & T.is_market_state(acc["status"]), F.lit(False))
        move = move & ~F.coalesce(acc["status"] == s, F.lit(False))
        return F.struct(
            F.when(fill | change, new).otherwise(old).alias("price"),
            F.when(move, s).otherwise(acc["status"]).alias("status"),
            F.when(T.blank(acc["url"]), u["url"]).otherwise(acc["url"]).alias("url"),
            (acc["price_changes"] + change.cast("int")).alias("price_changes"),
            F.when(change & (new < old), "down").when(change, "up").otherwise(acc["direction"]).alias("direction"),
            (acc["rescore"] | fill | change | move).alias("rescore"),
        ).cast(kind)

    history = updates.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "new_price", "new_status", "url"))).alias("__u"))
    start = F.struct(F.col("price"), F.col("listing_status"), F.col("listing_url"), F.lit(0), F.lit(None), F.lit(False)).cast(kind)
    folded = listings.join(history, "listing_id").withColumn("__f", F.aggregate("__u", start, step))
    return folded.select("listing_id", "__f.*")


def fold_status_windowed(updates: DataFrame) -> DataFrame:
    """(listing_id, status): the last market state, settled, else the last label."""
    w = Window.partitionBy("listing_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = F.when(T.is_market_state(F.col("new_status")), settled_status(F.col("new_status")))
    out = updates.select("listing_id", F.coalesce(F.last(state, True).over(w), F.last(F.nullif("new_status", F.lit("")), True).over(w)).alias("status"))
    return out.distinct()


def one_update(updates: DataFrame, key: str, columns: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns): one row of each key, the last by ``order`` (nulls first), then the greatest by its columns.

    Only map-side aggregation, so many updates of one key meet as one row a task.
    """
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in [*order, *columns]])
    last = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("__u"))
    return last.select(key, *[F.col("__u")[c].alias(c) for c in columns])


def coalesce_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str], force: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Fills null and blank cells of ``target`` from ``updates``; with ``force`` overwrites.

    Of several updates of a key the last by ``order`` counts, see ``one_update``; the
    rows of ``target`` stay as many as they were.
    """
    if not columns:
        return target
    given = one_update(updates, key, columns, order).select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    out = target.join(given, key, "left")
    text = {f.name for f in target.schema.fields if f.dataType.typeName() == "string"}
    for c in columns:
        old = F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) if force else F.coalesce(old, F.col(f"__new_{c}"), F.col(c)))
    return out.select(*target.columns)


def partial_enrich_update(target: DataFrame, updates: DataFrame, key: str, allowed: list[str], as_of: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """Only whitelisted columns that the update has, the last update by ``order``; stamps enriched_at where a row was met."""
    columns = [c for c in allowed if c in updates.columns and c in target.columns]
    met = updates.select(key).distinct().withColumn("__met", F.lit(True))
    out = coalesce_update(target, updates, key, columns, True, order).join(met, key, "left")
    old = F.col("enriched_at") if "enriched_at" in target.columns else F.lit(None)
    return out.withColumn("enriched_at", F.when(F.col("__met"), as_of).otherwise(old)).drop("__met")


def first_non_null_merge(base: DataFrame, sources: list[DataFrame], key: str, columns: list[str], core: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Fills each missing field from the first source that has it; lists core fields still missing.

    Of a source's rows for a key the last by ``order`` counts.
    """
    out = base
    for source in sources:
        out = coalesce_update(out, source, key, [c for c in columns if c in source.columns], order=order)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in core]))
    return out.withColumn("core_missing", missing).withColumn("ok", F.size("core_missing") == 0)


def assign_agent(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds agent: by the exact address of the sender, else by its domain; of agents that share a pattern the first by name."""
    bare = F.lower(F.trim(F.coalesce(T.extract(F.col("sender"), "<([^>]+)>"), F.col("sender"))))
    out = messages.withColumn("__mail", bare).withColumn("__domain", F.substring_index("__mail", "@", -1))
    exact = agents.filter(F.col("pattern").contains("@")).groupBy(F.lower("pattern").alias("__mail")).agg(F.min("agent").alias("__exact"))
    domain = agents.filter(~F.col("pattern").contains("@")).groupBy(F.lower("pattern").alias("__domain")).agg(F.min("agent").alias("__by_domain"))
    out = out.join(exact, "__mail", "left").join(domain, "__domain", "left")
    return out.withColumn("agent", F.coalesce("__exact", "__by_domain")).drop("__mail", "__domain", "__exact", "__by_domain")


def set_flag(events: DataFrame) -> DataFrame:
    """Latest value of each (listing_id, flag); ``set_by`` is cleared when unset."""
    last = events.groupBy("listing_id", "flag").agg(F.max_by(F.struct("value", "set_by"), F.struct("ts", "event_id")).alias("x"))
    return last.select("listing_id", "flag", "x.value", F.when(F.col("x.value"), F.col("x.set_by")).alias("set_by"))


def reconcile(export: DataFrame, listings: DataFrame) -> DataFrame:
    """Class of each exported home: missing, price_drift (with delta) or in_sync."""
    known = listings.filter(F.col("home_id").isNotNull()).groupBy("home_id").agg(F.min(F.struct("listing_id", "price")).alias("l"))
    out = export.withColumn("home_id", F.col("home_id").cast("string")).join(known, "home_id", "left")
    delta = F.col("price") - F.col("l.price")
    kind = F.when(F.col("l").isNull(), "missing").when(delta != 0, "price_drift").otherwise("in_sync")
    return out.select("home_id", F.col("price").alias("new_price"), F.col("l.price").alias("old_price"), F.when(delta != 0, delta).alias("delta"), kind.alias("class"))


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")
