"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of 60 bits. The words of each source are summed by hash
bucket, the bucket in which the source's budget ends is found, and only the documents of
that bucket are summed again by the next bits of their hash, until a bucket is a single
hash value. What remains is one threshold per source, so that choosing the documents is a
filter: nothing is sorted and no document is looked at next to another one. A larger
budget only raises the threshold, so the choices are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.llm.common import Scratch, count_words, spare

#: Shares of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MAX_REPEATS = 3
#: Bits of the hash that one histogram resolves.
LEVELS = (12, 16, 16, 16)


#: Rows up to which a table of sources is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def document_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of id and text: the same on every run and engine."""
    key = F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))
    )
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row per source.

    The targets share the sum of all sizes by weight; where a target would pass
    ``repeats`` times its source's size it stops there and the rest share the excess by
    weight, until none is above. That is the level at which min(cap, level * weight) adds
    up to the sum; caps are met in the order of cap / weight, so running sums find it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.select(
        "source",
        "source_size",
        "weight",
        "cap",
        ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # the first level that its own source's cap does not undercut holds for all after it
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(
        Window.partitionBy()
    )
    at = F.coalesce(open_level["level"], F.max("level").over(Window.partitionBy()))
    return level.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), at * F.col("weight")).alias("target")
    )


def thresholds(scratch: Scratch, sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the documents with a hash below it fill the source's budget.

    ``sized`` has source, size and hash; ``budgets`` has source and budget. The last
    document is taken if that comes nearer to the budget than leaving it. Documents with
    the same hash are taken or left together.
    """
    shift = sum(LEVELS)
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    state = scratch.table(state, "budgets")
    for k, bits in enumerate(LEVELS):
        shift_up, shift = shift, shift - bits
        inside = sized.join(small(state), (sized["source"].eqNullSafe(state["source"])) & (F.shiftright("hash", shift_up) == F.col("prefix")))
        histogram = inside.groupBy(sized["source"].alias("source"), F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("left").alias("left")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        upto = histogram.withColumn("upto", F.sum("size").over(run))
        # the bucket in which the budget ends: the first whose running sum passes it
        ends = upto.filter("upto > left").groupBy("source").agg(
            F.min(F.struct("bucket", "upto", "size", "left")).alias("b")
        )
        state = scratch.table(
            ends.select("source", F.col("b.bucket").alias("prefix"), (F.col("b.left") - F.col("b.upto") + F.col("b.size")).alias("left"), F.col("b.size").alias("size")),
            f"level_{k}",
        )
        if k < len(LEVELS) - 1:
            state = state.drop("size")
    nearer = (F.col("size") - F.col("left") <= F.col("left")).cast("long")
    return state.select("source", (F.col("prefix") + nearer).alias("threshold"))


def plan_mix(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(name, source_size, target, whole, threshold) of each source of ``sized``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")
    )
    targets = scratch.table(targets, "targets")
    limits = thresholds(scratch, sized, targets.filter("budget > 0"))
    plan = targets.alias("t").join(limits.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    return scratch.table(
        plan.select(
            F.col("t.source").alias("name"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")
        ),
        "plan",
    )


def _sized(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return scratch.table(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            count_words(F.col(text_col)).alias("size"),
            document_hash(id_col, text_col).alias("hash"),
        ),
        "sized",
    )


def mix_to_weights(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies, source) for every row of ``docs``.

    A document is taken ``copies`` times: the whole number of times that its source fits
    into the target, and once more if its hash lies below its source's threshold.

    Defined results: null and empty texts have size 0 and take 0 words; a null source is
    a source of its own, after all others; sources of size 0 have target 0. Repeated
    rows have the same hash and are taken or left together. An empty table gives an empty
    result. Further columns are not read.

    The sources themselves, one row each, pass through one task to be ranked: that is a
    list of names, not data. Their budgets are broadcast if they are few.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = _sized(scratch, docs, id_col, text_col, source_col)
    plan = plan_mix(scratch, sized, weights, repeats)
    out = sized.join(small(plan), F.col("source").eqNullSafe(F.col("name")), "left")
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        "source",
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``docs`` with each row as often as ``mix_to_weights`` takes it, from none on.

    All columns pass through; the texts themselves are scanned, never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    plan = plan_mix(scratch, _sized(scratch, docs, id_col, text_col, source_col), weights, repeats)
    name, whole, limit, copies, copy = spare(docs, "name", "whole", "limit", "copies", "copy")
    plan = plan.select(F.col("name").alias(name), F.col("whole").alias(whole), F.col("threshold").alias(limit))
    out = docs.join(small(plan), F.col(source_col).eqNullSafe(F.col(name)), "left")
    out = out.withColumn(copies, F.col(whole) + (document_hash(id_col, text_col) < F.col(limit)).cast("long")).filter(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
