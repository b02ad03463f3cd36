"""Schema and table utilities: alignment, keyed upserts, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingspark.operators.resolve import with_keys
from listingspark.operators.score import input_fingerprint


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds the columns of ``schema`` that are missing, as typed nulls; applied twice, the same."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns]
    return df.select("*", *missing)


def recompute_keys(df: DataFrame) -> DataFrame:
    """(listing_id, old_key, new_key) of rows whose address key is out of date."""
    out = df.withColumnRenamed("address_key", "old_key") if "address_key" in df.columns else df.withColumn("old_key", F.lit(None).cast("string"))
    new = with_keys(out).withColumnRenamed("address_key", "new_key")
    return new.filter(~F.col("old_key").eqNullSafe(F.col("new_key"))).select("listing_id", "old_key", "new_key")


def backfill_fingerprints(listings: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """``scores`` with a fingerprint where none is, that was scored and not enriched since."""
    prints = listings.select("listing_id", input_fingerprint(columns).alias("__print"))
    fit = F.col("input_fingerprint").isNull() & F.col("scored_at").isNotNull() & ~F.coalesce(F.col("enriched_at") > F.col("scored_at"), F.lit(False))
    out = scores.join(prints, "listing_id", "left")
    return out.withColumn("input_fingerprint", F.when(fit, F.col("__print")).otherwise(F.col("input_fingerprint"))).drop("__print")


def backfill_notified(df: DataFrame, sentinel: str = "1970-01-01 00:00:00") -> DataFrame:
    """Marks rows as notified; those without a time get the sentinel."""
    stamp = F.coalesce(F.col("notified_at"), F.lit(sentinel).cast("timestamp_ntz")) if "notified_at" in df.columns else F.lit(sentinel).cast("timestamp_ntz")
    return df.withColumns({"notified": F.lit(True), "notified_at": stamp})


def kv_latest(df: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Last write of each key."""
    return df.groupBy(key).agg(F.max_by("value", F.struct(*order)).alias("value"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` put in or put over by key.

    Of several updates of a key the one with the greatest hash counts, on every run alike;
    ``last_of`` keeps the last by an order of its own.
    """
    both = target.withColumn("__age", F.lit(1)).unionByName(updates.withColumn("__age", F.lit(0)), allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy("__age", F.xxhash64(*target.columns).desc())
    return both.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn", "__age")


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``, then by the hash of the row."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*df.columns).desc())
    return df.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def populated(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(~s.isin("", "[]", "null"), F.lit(False))
