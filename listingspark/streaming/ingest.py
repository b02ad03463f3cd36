"""Ingest of messages with exactly-once effects: an anti-join on what is processed, committed by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listingspark.operators.tables import last_of

Extract = Callable[[DataFrame], DataFrame]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of batch folders, None as long as it is empty."""
    try:
        return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query whose state a checkpoint holds, the same after every restart."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"]


def processed_messages(spark: SparkSession, path: str) -> DataFrame | None:
    """(message_id, sender, subject, ts, n_listings, day, run, batch) of all committed batches, None before the first."""
    return _read(spark, f"{path}/processed")


def ingested(spark: SparkSession, path: str, table: str = "listings") -> DataFrame | None:
    """The listings, or messages, of committed batches: those of a batch that was cut off are not among them."""
    rows, done = _read(spark, f"{path}/{table}"), processed_messages(spark, path)
    if rows is None or done is None:
        return None
    return rows.join(F.broadcast(done.select("run", "batch").distinct()), ["run", "batch"], "left_semi")  # a row for each micro-batch


def ingest_batch(batch: DataFrame, path: str, run: str, number: int, extract: Extract | None = None) -> None:
    """Writes what a micro-batch brings that no other batch has brought; repeated, it writes the same.

    Of a message's rows in the batch the earliest counts, then the least by its texts. What
    counts as processed is what other batches have committed, never this one itself, so a
    batch that runs again finds what it found before. Only days of the batch's own
    messages are read from the processed table: a repeat bears its message's time. Messages and
    listings are written first, and the batch is committed by its processed messages.
    """
    spark = batch.sparkSession
    rows = batch.filter("message_id is not null").withColumn("day", F.to_date("ts"))
    others = [c for c in batch.columns if c != "message_id"]
    one = rows.groupBy("message_id").agg(F.min(F.struct("ts", *[c for c in others if c != "ts"], "day")).alias("m")).select("message_id", *[F.col("m")[c].alias(c) for c in [*others, "day"]])
    done = processed_messages(spark, path)
    if done is not None:
        days = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).head()
        before = done.filter(~((F.col("run") == run) & (F.col("batch") == number)))
        before = before.filter(F.col("day").between(days.first, days.last) | F.col("day").isNull()) if days.first else before.filter("day is null")
        one = one.join(before.select("message_id"), "message_id", "left_anti")
    key = f"run={run}/batch={number}"
    one.write.mode("overwrite").parquet(f"{path}/messages/{key}")
    new = spark.read.schema(one.schema).parquet(f"{path}/messages/{key}")
    counted = new.withColumn("n_listings", F.lit(0).cast("long"))
    if extract is not None:
        extract(new).write.mode("overwrite").parquet(f"{path}/listings/{key}")
        made = spark.read.parquet(f"{path}/listings/{key}").groupBy("message_id").agg(F.count("*").alias("n"))
        counted = new.join(made, "message_id", "left").withColumn("n_listings", F.coalesce("n", F.lit(0).cast("long")))
    processed = counted.select("message_id", *[c for c in ("sender", "subject", "ts") if c in counted.columns], "n_listings", "day")
    processed.write.mode("overwrite").parquet(f"{path}/processed/{key}")


def ingest_stream(messages: DataFrame, path: str, checkpoint: str, extract: Extract | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A running query that ingests a stream of messages into the tables under ``path``, each message once.

    ``extract`` makes rows with a message_id of the new messages, such as ``extract_listings``. A
    restart takes up the batch that was cut off; even under a new checkpoint, which
    reads the source from its start, messages of earlier runs are not taken again.
    """
    spark = messages.sparkSession
    state: dict[str, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        run = state.setdefault("run", _run_of(spark, checkpoint))
        ingest_batch(batch, path, run, number, extract)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A running query that appends each micro-batch to a table, once whatever is repeated.

    Nothing written before is read or rewritten; ``latest_rows`` takes the last row of each key at read.
    """
    spark = rows.sparkSession
    state: dict[str, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        run = state.setdefault("run", _run_of(spark, checkpoint))
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_rows(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The last row of each key by ``order``, then by batch; None before the first batch."""
    found = _read(spark, path)
    return None if found is None else last_of(found, keys, [*order, "batch"]).drop("run", "batch")
