"""Line deduplication: lines that many documents share stay in one of them only.

Texts are exploded into normalised lines, which are counted by a hash of 128 bits. The
rows that meet are hashes and positions, never texts; a text is read again only to be put
together from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import SPACES, Scratch, spare, split_heavy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key has so many code points at least, and is dropped if so many documents hold it.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5


def lines_of(text: Column) -> Column:
    """The lines of a text; null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def hashes(*values: Column) -> tuple[Column, Column]:
    """128 bits of the values as two longs."""
    return F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)


def long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(r1, r2, doc, pos, h1, h2) of each line with a key of ``least_chars`` code points or more.

    r1 and r2 stand for the row's id and text, h1 and h2 for the key.
    """
    r1, r2 = hashes(F.col(id_col), F.coalesce(text_col, F.lit("")))
    lines = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(id_col).alias("doc"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least_chars)
    h1, h2 = hashes(F.col("key"))
    return keyed.select("r1", "r2", "doc", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, keeper, n_lines) of the keys found in so many documents: the largest id keeps its lines.

    Lines are counted by key and document first, so a key that a third of all documents
    hold is dealt out by document, and then leaves one row a task.
    """
    by_document = lines.groupBy("h1", "h2", "doc").agg(F.count("*").alias("c"))
    return (
        by_document.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc").alias("keeper"), F.sum("c").alias("n_lines"))
        .filter(F.col("n") >= least_documents)
        .drop("n")
    )


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, which replace columns of these names.

    A key in ``least_documents`` documents or more loses all its lines except in the
    largest id that holds it, which keeps each of its repeats. A null text is one empty
    line. A document is an id: rows of one id count once for a key and are cut each by
    itself, equal rows alike; all rows with a null id are one document, smaller than any
    other. An empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "kept_text")])
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = long_lines(docs, id_col, text_col, least_chars)
    shared = scratch.table(shared_keys(lines, least_documents), "shared")
    heavy, light = (part.drop("n_lines") for part in split_heavy(shared, "n_lines"))
    # lines of heavy keys meet their few rows where they are; they take part in the other join under
    # their row's hash, so that only the lines of light keys are dealt out by key
    met = lines.join(F.broadcast(heavy.withColumnRenamed("keeper", "__heavy")), ["h1", "h2"], "left")
    known = F.col("__heavy").isNotNull()
    met = met.withColumns({"h1": F.when(known, F.col("r1")).otherwise(F.col("h1")), "h2": F.when(known, F.col("r2")).otherwise(F.col("h2"))})
    met = met.join(light, ["h1", "h2"], "left").withColumn("keeper", F.coalesce("__heavy", "keeper"))
    gone = met.filter(F.col("keeper").isNotNull() & ~F.col("doc").eqNullSafe(F.col("keeper")))
    r1, r2, positions, lines_col = spare(docs, "r1", "r2", "gone", "lines")
    gone = gone.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.collect_set("pos").alias(positions))
    k1, k2 = hashes(F.col(id_col), F.coalesce(text_col, F.lit("")))
    met = docs.withColumns({r1: k1, r2: k2}).join(gone, [r1, r2], "left").withColumn(lines_col, lines_of(F.col(text_col)))
    n = F.size(lines_col)
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col(positions))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col(lines_col), i)), "\n")
    return met.select(
        *docs.columns,
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(positions), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(positions).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(kept).alias("kept_text"),
    )
