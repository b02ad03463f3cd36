"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the count, the sums and the spectrum of the scatter of the rows it has seen:
a row is a centred rank-one update, whose eigenvalues are the roots of a secular equation.
Spectra of tasks are combined by one rank-one update for each eigenpair and one for the
distance of the means, FAN_IN at a time. A last pass over all rows projects them on the basis found
(Rayleigh-Ritz), which brings the eigenvectors to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import Scratch

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Spectra that one task combines.
FAN_IN = 16
#: An eigenvalue is taken for zero below this part of the largest, for each dimension.
ZERO = 1e-14
#: Entries of this size or more do not fit a long with room for sums of pairs, and count as not finite.
LARGEST = 2.0**55

EPS, TINY = np.finfo(float).eps, np.finfo(float).tiny


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)) for rising ``d`` and ``z`` without zeros, one in each gap and one above.

    Returned as (place of the nearer pole, distance from it), which keeps the differences
    to all poles exact. All roots are sought at once: rational steps in a bracket.
    """
    k, z2 = len(d), z * z
    top = d[-1] + z2.sum()
    right = np.append(d[1:], top)
    middle = (d + right) / 2
    f = 1 + (z2 / (d - middle[:, None])).sum(1)
    near = np.arange(k)
    upper = (f < 0) & (near < k - 1)  # the root lies in the upper half of its gap
    pole = np.where(upper, near + 1, near)
    gap = d - d[pole][:, None]  # [root, pole]
    lo = np.where(upper, middle - right, 0.0)
    hi = np.where(upper, 0.0, middle - d)
    last_high = f[-1] < 0
    lo[-1], hi[-1] = (middle[-1] - d[-1], top - d[-1]) if last_high else (0.0, middle[-1] - d[-1])
    x = (lo + hi) / 2
    if k == 1:
        return pole, z2.copy()
    left = np.tri(k) * z2  # of poles up to the root's own
    left[-1, -1] = 0
    a_at = np.append(near[:-1], k - 2)
    b_at = np.append(near[1:], k - 1)
    for _ in range(60):
        inverse = 1 / (gap - x[:, None])
        f = 1 + inverse @ z2
        size = 1 + np.abs(inverse) @ z2
        done = np.abs(f) <= k * EPS * size
        lo, hi = np.where(f < 0, np.maximum(lo, x), lo), np.where(f > 0, np.minimum(hi, x), hi)
        if np.all(done | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))):
            break
        inverse *= inverse
        psi = np.einsum("ij,ij->i", inverse, left)
        phi = np.einsum("ij,ij->i", inverse, z2 - left)
        a, b = gap[near, a_at] - x, gap[near, b_at] - x
        c = f - a * psi - b * phi
        p = (a + b) * f - a * b * (psi + phi)
        q = a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        p[-1] = -p[-1]  # the last root takes the other solution of its equation
        with np.errstate(divide="ignore", invalid="ignore"):  # a step without a value becomes half the bracket
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        step[-1] = -step[-1]
        new = x + step
        x = np.where(done, x, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return pole, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors diag(values) vectors' + v v', values rising.

    Deflation: directions that ``v`` does not touch stay, and of those with equal values one
    is turned to hold all of ``v`` there, so that the rest stay as well.
    """
    z = vectors.T @ v
    scale = max(abs(values[-1]), abs(values[0]), float(z @ z))
    if scale == 0:
        return values, vectors
    tolerance = 8 * EPS * scale
    values, vectors = values.copy(), vectors.copy()
    cuts = np.flatnonzero(np.diff(values) > tolerance) + 1
    if len(cuts) + 1 < len(values):
        for begin, end in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if end - begin > 1:
                part = z[begin:end].copy()
                norm = np.linalg.norm(part)
                if norm > 0:  # a reflection takes ``part`` to its last place
                    sign = 1.0 if part[-1] >= 0 else -1.0
                    part[-1] += sign * norm
                    part /= np.linalg.norm(part)
                    vectors[:, begin:end] -= 2 * np.outer(vectors[:, begin:end] @ part, part)
                    z[begin:end] = 0
                    z[end - 1] = -sign * norm
    live = np.flatnonzero(np.abs(z) * np.sqrt(scale) > tolerance)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    pole, x = secular_roots(d, w)
    differences = (d - d[pole][:, None]) - x[:, None]  # [root, pole]: d - root
    # entries of ``v`` for which these roots are exact, so that the new vectors are orthogonal
    apart = np.abs(d - d[:, None])
    np.fill_diagonal(apart, 1)
    logs = np.log(np.maximum(np.abs(differences), TINY)).sum(0) - np.log(np.maximum(apart, TINY)).sum(0)
    exact = np.copysign(np.exp(logs / 2), w)
    fresh = exact / np.where(differences == 0, EPS * scale, differences)
    fresh /= np.linalg.norm(fresh, axis=1)[:, None]
    values[live] = d[pole] + x
    vectors[:, live] = vectors[:, live] @ fresh.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and spectrum of the scatter of vectors with ``dim`` whole-number entries."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.mean, self.values, self.vectors = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, rows: np.ndarray) -> None:
        """Rows of longs, one centred rank-one update each."""
        for v in rows.astype(float):
            away = v - self.mean
            if self.n:
                self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + away / self.n
        self.sums = [s + (int(h) << 32) + int(l) for s, h, l in zip(self.sums, (rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0), strict=True)]

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the distance of the means, each a rank-one update."""
        both = self.n + other.n
        away = (other.mean - self.mean) * np.sqrt(self.n * other.n / both)
        for v in [away, *(other.vectors * np.sqrt(np.maximum(other.values, 0))).T]:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n, self.mean = both, np.array([s / both for s in self.sums])

    def row(self, part: int) -> tuple:
        return part, self.n, [str(s) for s in self.sums], np.concatenate([self.values, self.vectors.ravel()]).tolist()

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row.sums))
        out.n, out.sums = int(row.n), [int(s) for s in row.sums]
        out.mean = np.array([s / out.n for s in out.sums])
        numbers, dim = np.array(row.numbers, dtype=float), len(row.sums)
        out.values, out.vectors = numbers[:dim], numbers[dim:].reshape(dim, dim)
        return out


SPECTRUM = "part long, n long, sums array<string>, numbers array<double>"
SQUARE = "part long, numbers array<double>"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of longs of a list column without nulls, less SHIFT."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim) - SHIFT


def spectra(fit: DataFrame, dim: int) -> DataFrame:
    """The spectrum of the rows of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dim)
        for batch in batches:
            own.add(matrix(batch.column(0), dim))
        if own.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([own.row(TaskContext.get().partitionId())], columns=["part", "n", "sums", "numbers"]))

    return fit.select("x").mapInArrow(task, SPECTRUM)


def combine_spectra(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One spectrum of a group's, taken by their number."""
    first, *rest = [Spectrum.of(r) for r in rows.sort_values("part").itertuples()]
    for other in rest:
        first.merge(other)
    return pd.DataFrame([first.row(key[0])], columns=["part", "n", "sums", "numbers"])


def combine_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(key[0], np.sum(np.stack(rows.sort_values("part")["numbers"].to_list()), axis=0))], columns=["part", "numbers"])


def gathered(scratch: Scratch, parts: DataFrame, label: str, combine, schema: str):
    """The single row to which the rows of tasks come down, FAN_IN at a time; None without rows."""
    level = 0
    while True:
        parts = scratch.table(parts, f"{label}_{level}")
        scratch.drop(f"{label}_{level - 1}")
        if parts.count() <= 1:
            return parts.first()
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(combine, schema)
        level += 1


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, exact: longs if they hold it, else Python integers."""
    most = max([int(np.abs(y).max(initial=0)) * n, *map(abs, sums)])
    if most < 2**62:
        return n * y - np.array(sums, dtype=np.int64)
    return y.astype(object) * n - np.array(sums, dtype=object)


def products(fit: DataFrame, dim: int, n: int, sums: list[int], basis: np.ndarray) -> DataFrame:
    """For each task, the products of its centred rows on ``basis``, each with each, summed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            seen = (centred(matrix(batch.column(0), dim), n, sums) / n).astype(float) @ basis
            total = seen.T @ seen + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(TaskContext.get().partitionId(), total.ravel().tolist())], columns=["part", "numbers"]))

    return fit.select("x").mapInArrow(task, SQUARE)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite (below 2^55 / 64)."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def squares(centred_rows: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where a long does not hold it."""
    about = (centred_rows.astype(float) ** 2).sum(1)
    if centred_rows.dtype != object and (about < 4e18).all():
        return (centred_rows * centred_rows).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in r) for r in centred_rows]
    return [e if e < 2**63 else None for e in exact]


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are
    those not of the commonest length (of two, the greater). The distribution is
    that of the distinct vectors after rounding; repeated rows, and rows with a null id,
    get rows of their own. There are ``components`` components or as many as have an eigenvalue above
    zero, so a single distinct vector, or an empty table, gives no rows. deviation is null where it
    passes the largest long. Other columns are not carried.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    kind = dict(rows.dtypes)["id"]
    schema = f"`{id_col}` {kind}, {RESULT}"
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whiten")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.dim
    rounded = rows.filter(F.size("v") == dim).select("id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))
    fit = scratch.table(rounded.select("x").distinct(), "fit")
    tasks = max(spark.sparkContext.defaultParallelism, fit.count() // 20_000)
    with scratch.small_batches():
        whole = gathered(scratch, spectra(fit.repartition(tasks), dim), "spectra", combine_spectra, SPECTRUM)
    found = Spectrum.of(whole)
    n, sums = found.n, found.sums
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    seen = gathered(scratch, products(fit, dim, n, sums, basis), "refined", combine_sums, SQUARE)
    values, turns = np.linalg.eigh(np.array(seen.numbers).reshape(dim, dim) / n)
    values, vectors = values[::-1], (basis @ turns)[:, ::-1]
    kept = min(components, int((values > ZERO * dim * values[0]).sum()) if values[0] > 0 else 0)
    if not kept:
        return spark.createDataFrame([], schema)
    scaled = vectors[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / np.maximum(values, 0).sum()
    spread = gathered(scratch, products(fit, dim, n, sums, scaled), "spread", combine_sums, SQUARE)
    error = float(np.abs(np.array(spread.numbers).reshape(kept, kept) / n - np.eye(kept)).max())
    scratch.drop("fit")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = centred(matrix(batch.column(1), dim), n, sums)
            white = (exact / n).astype(float) @ scaled
            m = len(white)
            each = pa.array(np.repeat(np.arange(m), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n, dtype=np.int64)),
                    pa.array(squares(exact), pa.int64()).take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * kept, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rounded.mapInArrow(project, schema)
