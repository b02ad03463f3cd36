"""Shared helpers of the corpus operators: scratch tables, splits and text patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.session import ship_package

#: A word is a run of anything but ASCII white space (Java and Python regex alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch in jobs of an operator's own. In plans that it returns Spark's bound on a
#: batch's bytes holds; workers take slices of any batch by the bytes of their texts.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process, as in tests, a temporary folder
    is made and becomes the checkpoint folder. On a cluster executors would not see
    each other's files there, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


class Scratch:
    """Written tables of one run of an operator, in a folder of their own.

    Each table is a Parquet folder that every executor can read, so that a lost
    executor costs only the tasks it ran. ``drop`` removes a table that no later
    plan reads; what the returned plan still reads stays until the shared folder
    is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        ship_package(spark)

    @contextmanager
    def small_batches(self) -> Iterator[None]:
        """Jobs run inside send workers BATCH_ROWS rows at a time; the caller's setting comes back."""
        key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf
        before = conf.get(key)
        conf.set(key, str(BATCH_ROWS))
        try:
            yield
        finally:
            conf.set(key, before)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{label}"
        with self.small_batches():
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, label: str) -> str:
        return f"{self.path}/{label}"

    def drop(self, *labels: str) -> None:
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def count_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Keys that hold at least 1 / HEAVY_SHARE of a weight are heavy, so at most that many are.
HEAVY_SHARE = 1000


def split_heavy(table: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table``, a written table with one row a key, by their part of all weight.

    Weights are never negative. The first part has HEAVY_SHARE rows at most, whatever the table's size, and may be
    broadcast; a key of the second holds less than 1 / HEAVY_SHARE of the weight, so
    a shuffle join on it has no hot task.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("decimal(38,0)").alias("t")).first().t
    heavy = (F.col(weight) > 0) & (F.col(weight).cast("decimal(28,0)") * HEAVY_SHARE >= F.lit(total))
    return table.filter(heavy), table.filter(~heavy)
