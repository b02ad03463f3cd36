"""Quality classifier: histogram gradient-boosted trees over document statistics.

One scan turns every whole text into a row of statistics. The trees are grown on a
bounded sample of labelled rows from histograms of binned statistics, and flattened into
arrays of features, thresholds and leaf values, which numpy traverses for a whole batch
of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch, id_remainder

#: Labelled rows that the trees are grown on, at most about so many.
SAMPLE = 20_000

FEATURES = (
    "words",
    "chars",
    "word_length",
    "upper",
    "digits",
    "points",
    "stops",
    "shouts",
    "symbols",
    "bars",
    "brackets",
    "beyond_ascii",
    "spaces",
    "lines",
    "line_words",
    "distinct_words",
    "top_word",
    "twins",
    "distinct_pairs",
    "long_words",
    "short_words",
)

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "points": b".,;:?'\"-",
    "stops": b".",
    "shouts": b"!",
    "symbols": b"#*$%&<>@^~_=+",
    "bars": b"|",
    "brackets": b"()[]{}",
    "beyond_ascii": bytes(range(128, 256)),
    "spaces": b" \t\n\x0b\x0c\r",
    "lines": b"\n",
}


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, float64; of an empty text all are 0."""
    h, at, a, b = H.words(column)
    data, where = H.buffers(column)
    data = data[where[0] : where[-1]]
    where = where - where[0]
    size = np.diff(where)
    out = {"chars": np.log1p(size)}
    some = np.maximum(size, 1)
    for name, members in _CLASSES.items():
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        hits = table[data]
        total = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(hits, out=total[1:])
        out[name] = (total[where[1:]] - total[where[:-1]]) / some
    lines = out["lines"] * some + (size > 0)
    n = np.diff(at)
    one = np.maximum(n, 1)
    length = (b - a).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(length)])
    out["words"] = np.log1p(n)
    out["word_length"] = (run[at[1:]] - run[at[:-1]]) / one
    for name, hits in (("long_words", length > 18), ("short_words", length < 3)):
        run = np.concatenate([[0], np.cumsum(hits)])
        out[name] = (run[at[1:]] - run[at[:-1]]) / one
    out["lines"] = np.log1p(lines)
    out["line_words"] = n / np.maximum(lines, 1)
    distinct, top, pairs = (np.zeros(len(n)) for _ in range(3))
    twins = np.zeros(len(n))
    for i, (p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if q == p:
            continue
        w = h[p:q]
        counts = np.unique(w, return_counts=True)[1]
        distinct[i] = len(counts) / (q - p)
        top[i] = counts.max() / (q - p)
        if q - p > 1:
            twins[i] = (w[1:] == w[:-1]).mean()
            pairs[i] = len(np.unique(H.shingles(w, 2))) / (q - p - 1)
    out |= {"distinct_words": distinct, "top_word": top, "twins": twins, "distinct_pairs": pairs}
    return np.stack([np.where(size > 0, out[f], 0.0) for f in FEATURES], axis=1)


@dataclass
class Trees:
    """Complete trees of one depth: features and thresholds by node, values by leaf."""

    depth: int
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosts ``trees`` complete trees on binned columns by gradient histograms.

    Without rows, or with one class only, the score is one constant.
    """
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    nodes, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
        total = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, w = p - y, p * (1 - p)
            f, t = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            node = np.zeros(n, np.int64)
            for d in range(depth):
                first, width = 2**d - 1, 2**d
                gain, pick, cut = np.full(width, 1e-9), np.full(width, -1), np.zeros(width, np.int64)
                for k, column in enumerate(binned):
                    if not len(edges[k]):
                        continue
                    key = (node - first) * bins + column
                    hg, hw = (np.bincount(key, u, width * bins).reshape(width, bins).cumsum(axis=1) for u in (g, w))
                    lg, lw, ag, aw = hg[:, :-1], hw[:, :-1], hg[:, -1:], hw[:, -1:]
                    won = lg**2 / (lw + penalty) + (ag - lg) ** 2 / (aw - lw + penalty) - ag**2 / (aw + penalty)
                    won[(lw < least) | (aw - lw < least)] = 0
                    at = won.argmax(axis=1)
                    best = won[np.arange(width), at]
                    better = best > gain
                    gain[better], pick[better], cut[better] = best[better], k, at[better]
                for j in np.flatnonzero(pick >= 0):
                    f[first + j] = pick[j]
                    t[first + j] = edges[pick[j]][min(cut[j], len(edges[pick[j]]) - 1)]
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            leaf = node - nodes
            v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, w, leaves) + penalty)
            total += v[leaf]
            features.append(f)
            thresholds.append(t)
            values.append(v)
    shape = (len(features), nodes)
    return Trees(depth, base, np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(values).reshape(len(features), leaves))


def sampled(labelled: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most, by the hash of their id: the same on every run."""
    rate = max(1, -(-labelled.count() // bound))
    return labelled.filter(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out: Column | None = None,
    threshold: float = 0.3,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    The trees learn from labelled rows that are not ``held_out`` (by default crc32 of
    the id, modulo 5, is 0), about ``sample`` of them at most, chosen by the hash of the
    id, from the text's statistics alone.

    Defined results: a null or empty text has all statistics 0 and a score like any
    other; null labels teach nothing; null ids are held out and join no label; an id
    with several labels teaches each of them; repeated rows score alike; without usable
    labels every score is 0.5; further columns are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    held = id_remainder("id", 5) == 0 if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, "text", 1 << 20):
                x = statistics(batch.column("text"))
                flat = pa.array(x.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "x"])

    measured = scratch.table(rows.mapInArrow(measure, f"id {kind}, x array<double>"), "statistics")
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("y is not null").filter(~held)
    found = measured.join(sampled(marked, sample), "id").orderBy("id", "y", "x").select("x", "y").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    trees = spark.sparkContext.broadcast(grow(x, found["y"].to_numpy(dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(trees.value.score(x))], ["id", "score"])

    scored = measured.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
