"""Planning of work: what each listing lacks, and which tasks may run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.functions import text as T
from listingspark.operators.score import needs_score

ORDER = ("scrape_desc", "stats", "commute", "schools", "status", "score")


def gap_scan(listings: DataFrame, scores: DataFrame, version: int) -> DataFrame:
    """(listing_id, task) for everything that a listing lacks.

    Uses n_images, schools and fingerprint of ``listings`` besides its own columns.
    """
    has = lambda c: ~T.blank(F.col(c))
    core = F.col("price").isNull() | F.col("sqft").isNull() | F.col("bedrooms").isNull() | F.col("year_built").isNull()
    due = needs_score(listings, scores, version).select("listing_id", F.lit(True).alias("__due"))
    out = listings.join(due, "listing_id", "left")
    tasks = F.array_compact(
        F.array(
            F.when(T.blank(F.col("description")) | (F.coalesce(F.col("n_images"), F.lit(0)) == 0), "scrape_desc"),
            F.when(core & (has("listing_url") | has("description")), "stats"),
            F.when(F.col("commute_minutes").isNull() & has("address") & has("town"), "commute"),
            F.when(F.col("schools").isNull() & has("zip_code"), "schools"),
            F.when(T.status_class(F.col("listing_status")) == "unknown", "status"),
            F.when(F.col("__due"), "score"),
        )
    )
    return out.select("listing_id", F.explode(tasks).alias("task"))


def gap_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("task").agg(F.count("*").alias("n"))


def ready_tasks(tasks: DataFrame, limit: int = 20, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The next pending tasks: newest listing first, then in task order.

    A score task waits for every other task of its listing that runs or was never tried.
    """
    blocking = tasks.filter("task_type <> 'score' and (status = 'running' or (status = 'pending' and attempts = 0))").select("listing_id").distinct()
    usable = tasks.filter((F.col("status") == "pending") & (F.col("attempts") < 3) & ~F.col("task_type").isin(*exclude, ""))
    free = usable.filter("task_type = 'score'").join(blocking, "listing_id", "left_anti").unionByName(usable.filter("task_type <> 'score'"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("task_type"))
    return free.orderBy(F.col("listing_id").desc(), rank, "task_id").limit(limit)


def requeue(tasks: DataFrame, wanted: DataFrame, force: bool = False) -> DataFrame:
    """Tasks after asking for ``wanted`` (listing_id, task_type)."""
    ask = wanted.select("listing_id", "task_type").distinct().withColumn("__asked", F.lit(True))
    out = tasks.join(ask, ["listing_id", "task_type"], "full_outer")
    done = F.col("__asked") & (F.col("status") == "done")
    failed = F.col("__asked") & (F.col("status") == "failed")
    return out.select(
        "listing_id",
        "task_type",
        F.when(F.col("status").isNull() | done | failed, "pending").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status").isNull() | done, 0).when(failed, 0 if force else 2).otherwise(F.col("attempts")).cast("long").alias("attempts"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """(task_type, status, n): by status, and by task and status, in one pass."""
    sets = [["status"], ["task_type", "status"]]
    return tasks.groupingSets(sets, "task_type", "status").agg(F.count("*").alias("n"), F.grouping("task_type").alias("all_tasks"))
