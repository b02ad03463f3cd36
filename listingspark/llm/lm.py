"""Language-model scoring with a hashed maximum-entropy model and class-factored softmax.

The frequent words are units of their own; every other word, known or not, belongs to the
unit of its form, a hash of its ending. P(word | context) is P(class | context) *
P(unit | class, word before) * P(word | unit). Classes are groups of units that stand
beside the same frequent words. The class is a log-linear softmax over three features of the
context hashed to rows of weights: the word before, the word before that (a skip), and
both together. Below its class a unit is found by choices among BRANCH branches with one
feature each, the choice with the word before; for one feature a context the
maximum of the likelihood is known, its smoothed counts, so one gradient sum gives it.
A word has its smoothed share of its form's count, and one unseen word a form has a share
too, so that the model sums to one.

All sums over the corpus, counts and gradients alike, are whole numbers (gradients in
units of 1 / SCALE), so that neither the partitioning nor the order of rows changes a
score. Texts are read twice: to count their words, and to write their units. Every later
pass reads two bytes a token. A pass's sums have a fixed size, are added up as a stream by
block and come to the driver as one table of weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch, id_remainder

U = np.uint64
#: Counted words that are broadcast, at most; further ones are joined.
HEAD = 1 << 19
#: Units, of which the first FORMS are forms; two bytes hold a unit.
UNITS, FORMS = 1 << 15, 1 << 11
#: Occurrences from which a word is a unit of its own.
LEAST_UNIT = 5
#: Frequent words that tell the classes apart, classes, and branches of a choice.
BEACONS, CLASSES, BRANCH = 32, 32, 32
#: Hashed rows of the word before, of the skip and of both; rows of choices below the classes.
ROWS, NODE_ROWS = (1 << 14, 1 << 14, 1 << 15), 1 << 16
#: Words before that have rows of their own below the classes; the others stand for their class.
OWN = 1 << 13
#: Occurrences that a row's prior weighs: of the three class features, and of a choice.
PRIOR, NODE_PRIOR = (8.0, 8.0, 64.0), 100.0
#: Sixteenths of the training texts that each gradient round reads; together all of them.
ROUNDS = ((0, 2), (2, 5), (5, 10), (10, 16))
PARTS = 16
#: Step of a round, and occurrences that keep rows with few from wide steps.
RATE, CALM = 0.6, 8.0
#: Shares of a class as whole numbers.
SCALE = 1 << 12
#: Bound of a weight; three of them stay far within what float32 exponentials bear.
MOST_WEIGHT = 12.0
STEP = 16384
BLOCKS = 32
#: Tokens that one task of a pass sums up, about; its sums are a few megabytes.
TASK_TOKENS = 16_000_000
#: Stands for the end of a text; no word hashes are made this way.
END = U(0x5D1E0FAD5D1E0FAD)


class Table:
    """Places of 64-bit keys, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = U(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=U)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.values[slot] < 0
            mine = left[free]
            self.keys[slot[free]] = keys[mine]
            self.values[slot[free]] = values[mine]
            lost = (self.keys[slot] != keys[left]) | (self.values[slot] < 0)
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def get(self, h: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            value = self.values[slot]
            out[open_] = value
            more = (value >= 0) & (self.keys[slot] != h[open_])
            open_, slot = open_[more], slot[more]
        return out


@dataclass
class Words:
    """The broadcast head of the vocabulary, by falling count; the first ``own`` are units."""

    table: Table
    counts: np.ndarray
    own: int
    form_log: np.ndarray  # log10 of what the smoothed counts of each form add up to

    def units(self, place: np.ndarray, form: np.ndarray) -> np.ndarray:
        return np.where((place >= 0) & (place < self.own), place + FORMS, form)


@dataclass
class Shape:
    """Classes of the units and the choices that lead from a class to a unit."""

    cls: np.ndarray  # class of each unit
    node: np.ndarray  # units x 3, the node of each choice or -1
    branch: np.ndarray  # units x 3
    prior: np.ndarray  # nodes x BRANCH, shares without a context
    last: np.ndarray  # the last branch of each node; hashed rows may hold counts of more
    class_prior: np.ndarray
    near: np.ndarray  # what a unit counts as when it is the word before; START last


@dataclass
class Model:
    shape: Shape
    weights: np.ndarray  # hashed rows of all features x classes
    node_counts: np.ndarray  # NODE_ROWS x BRANCH
    node_upto: np.ndarray  # their running sums over the branches


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with the hashes and forms of their tokens, an end after each text, and offsets."""
    for part in H.chunks(batch, "text", 2 << 20):
        column = part.column("text")
        h, at, a, b = H.words(column)
        n = np.diff(at)
        edge = np.concatenate([[0], np.cumsum(n + 1)])
        ends = edge[1:] - 1
        inner = np.ones(len(h) + len(n), dtype=bool)
        inner[ends] = False
        out, form = np.empty(len(inner), dtype=U), np.zeros(len(inner), dtype=np.int32)
        out[inner], out[ends] = h, END
        form[inner] = _forms(column, a, b)
        yield part, out, form, edge


def _forms(column: pa.Array, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The form of each word: a hash of its last four bytes."""
    data, at = H.buffers(column)
    data = data[int(at[0]) : int(at[-1])]
    x = np.zeros(len(end), dtype=U)
    for k in range(1, 5):
        byte = H.LOWER[data[np.maximum(end - k, start)]].astype(U)
        x = (x << U(8)) | np.where(end - k >= start, byte, U(0))
    return (H.mix(x + U(1)) >> U(64 - FORMS.bit_length() + 1)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, combined in the task over some millions of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        forms = np.concatenate([x[1] for x in held])
        words, first, counts = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(forms[first]), pa.array(counts)], ["h", "form", "c"])

    for batch in batches:
        for _, tokens, form, _ in _texts(batch):
            held.append((tokens, form))
            n += len(tokens)
            if n > 3_000_000:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def head_count(vocabulary: DataFrame, most: int) -> int:
    """The smallest count at which at most ``most`` words occur so often, exactly.

    Counts are first taken by their leading ten bits, then those of the bucket in which
    the bound falls one by one, so that either table has some ten thousand rows at most
    (the second some more where a count passes 2^24).
    """
    lead = F.greatest(F.length(F.bin("c")) - 10, F.lit(0))
    coarse = F.expr("shiftleft(shiftright(c, greatest(length(bin(c)) - 10, 0)), greatest(length(bin(c)) - 10, 0))")
    above, edge = 0, None
    for r in vocabulary.groupBy(coarse.alias("low"), lead.alias("bits")).count().orderBy(F.col("low").desc()).collect():
        if above + r["count"] > most:
            edge = (r["low"], r["low"] + (1 << r["bits"]))
            break
        above += r["count"]
    if edge is None:
        return 1
    least = edge[1]
    inside = vocabulary.filter((F.col("c") >= edge[0]) & (F.col("c") < edge[1]))
    for r in inside.groupBy("c").count().orderBy(F.col("c").desc()).collect():
        above += r["count"]
        if above > most:
            break
        least = r["c"]
    return least


def known_words(vocabulary: DataFrame) -> tuple[Words, np.ndarray]:
    """The head of the vocabulary, and what the smoothed counts of each unit add up to."""
    head = vocabulary.filter(F.col("c") >= head_count(vocabulary, HEAD)).toArrow()
    keys, counts, forms = head["h"].to_numpy().view(U), head["c"].to_numpy(), head["form"].to_numpy()
    order = np.lexsort((keys, -counts))
    keys, counts, forms = keys[order], counts[order], forms[order]
    own = int(min(UNITS - FORMS, np.searchsorted(-counts, -LEAST_UNIT, side="right")))
    found = vocabulary.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    mass = np.zeros(UNITS)
    mass[:FORMS] = 0.1
    mass[found["form"].to_numpy()] += found["c"].to_numpy() + 0.1 * found["n"].to_numpy()
    np.subtract.at(mass, forms[:own], counts[:own] + 0.1)
    mass[:FORMS] = np.maximum(mass[:FORMS], 0.1)  # a form without other words keeps the unseen one
    mass[FORMS : FORMS + own] = counts[:own]
    return Words(Table(keys, np.arange(len(keys))), counts, own, np.log10(mass[:FORMS])), mass


def _encoder(words, log_all: float):
    """Per text: what the broadcast counts settle, its units, and the words they do not know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = words.value
        row = TaskContext.get().partitionId() << 36
        log_counts = np.log10(np.append(w.counts, 0.9) + 0.1)  # the last one, log 1, for words without a count
        log_counts[-1] = 0.0
        for batch in batches:
            for part, tokens, form, edge in _texts(batch):
                n = np.diff(edge)
                place = w.table.get(tokens)
                known = place >= 0
                log_count = log_counts[place]
                units = w.units(place, form)
                share = np.where(units < FORMS, log_count - w.form_log[np.minimum(units, FORMS - 1)], 0.0)
                sums = [np.add.reduceat(x, edge[:-1]) if len(n) else x[:0] for x in (log_count - log_all, share, known.astype(np.int64))]
                far = np.flatnonzero(~known)
                owner = np.searchsorted(edge, far, side="right") - 1
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)), pa.array(tokens[far].view(np.int64))
                )
                data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * edge).astype(np.int32)), pa.py_buffer(units.astype("<u2"))])
                ids = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column("id"), part.column("part"), pa.array(n), *map(pa.array, sums), lists, data],
                    ["row", "id", "part", "n", "base", "share", "known", "far", "units"],
                )

    return run


def _unit_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with their units, about ``most`` tokens or one text, and offsets."""
    for batch in batches:
        for part in H.chunks(batch, "units", 2 * most):
            data, at = H.buffers(part.column("units"))
            units = data[int(at[0]) : int(at[-1])].view("<u2").astype(np.int64)
            yield part, units, (at - at[0]) // 2


def _contexts(units: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; UNITS stands before a text."""
    one, two = np.empty_like(units), np.empty_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    one[:1] = two[:2] = UNITS
    starts = edge[:-1]
    one[starts] = two[starts] = UNITS
    second = starts + 1
    two[second[second < edge[1:]]] = UNITS
    return one, two


def _hashed(x: np.ndarray, rows: int) -> np.ndarray:
    return (H.mix(x.astype(U)) >> U(64 - rows.bit_length() + 1)).astype(np.int64)


def _feature_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """The rows of the three features of each token, over all features."""
    single = np.arange(1, UNITS + 2)
    before, skip = _hashed(single, ROWS[0]), _hashed(single << 20, ROWS[1])
    return [before[one], ROWS[0] + skip[two], ROWS[0] + ROWS[1] + _hashed(((one + 1) << 40) | (two + 1), ROWS[2])]


def _node_rows(near: np.ndarray, node: np.ndarray) -> np.ndarray:
    return _hashed((near << 32) | (node + 1), NODE_ROWS)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, most of them small, as compressed bytes: all lowest bytes first."""
    rows = x.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(rows), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    rows = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(rows.T).view("<i8").reshape(-1)


def _summed(table: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, tasks: int) -> np.ndarray:
    """What ``sums`` adds up over the partitions of ``table``: whole numbers, ``size`` of them.

    Each task sends blocks of its sums; those of one block meet in one task, which adds
    them up as they come.
    """
    edges = np.linspace(0, size, BLOCKS + 1).astype(np.int64)
    schema = "block int, sums binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sums(batches)
        for k in range(BLOCKS):
            x = found[edges[k] : edges[k + 1]]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(x)], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[k] = held[k] + unpack(x) if k in held else unpack(x)
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(x)], pa.binary())], ["block", "sums"])

    few = table.coalesce(max(tasks, table.sparkSession.sparkContext.defaultParallelism))  # each task sends as much, however little it reads
    out = np.zeros(size, np.int64)
    for r in few.mapInArrow(send, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect():
        out[edges[r["block"]] : edges[r["block"] + 1]] += unpack(r["sums"])
    return out


def _beside(beacon: np.ndarray):
    """Counts of beacons one and two before and one behind each unit."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(UNITS * BEACONS, np.int64)
        place = np.full(UNITS + 1, -1)
        place[beacon] = np.arange(len(beacon))
        for _, units, edge in _unit_slices(batches, 1 << 20):
            one, two = _contexts(units, edge)
            here = place[units]
            for of, b in ((units, place[one]), (units, place[two]), (one, here)):
                at = np.flatnonzero((b >= 0) & (of < UNITS))
                out += np.bincount(of[at] * BEACONS + b[at], minlength=len(out))
        return out

    return sums


def classes(beside: np.ndarray) -> np.ndarray:
    """A class for each unit: groups whose beacons have the same distribution.

    Hard expectation steps over multinomials, from units far from each other on.
    """
    m = beside.reshape(UNITS, BEACONS).astype(np.float64)
    overall = (m.sum(axis=0) + 1) / (m.sum() + BEACONS)
    tops = np.argsort(-m.sum(axis=1), kind="stable")[:2000]
    sides = np.sqrt((m[tops] + overall) / (m[tops].sum(axis=1) + 1)[:, None])
    seeds, nearest = [0], sides @ sides[0]
    for _ in range(CLASSES - 1):
        k = int(np.argmax((1 - nearest) * np.log1p(m[tops].sum(axis=1))))
        seeds.append(k)
        nearest = np.maximum(nearest, sides @ sides[k])
    theta = m[tops[seeds]] + 20 * overall
    share = np.ones(CLASSES)
    cls = np.zeros(UNITS, np.int64)
    for _ in range(15):
        fit = m @ np.log(theta / theta.sum(axis=1, keepdims=True)).T + np.log(share / share.sum())
        cls = fit.argmax(axis=1)
        theta = np.zeros((CLASSES, BEACONS))
        np.add.at(theta, cls, m)
        theta += 20 * overall
        share = np.bincount(cls, minlength=CLASSES) + 1.0
    return cls


def shape_of(cls: np.ndarray, mass: np.ndarray) -> Shape:
    """Places the units of each class in a tree of choices, frequent ones together."""
    real = np.flatnonzero(mass > 0)
    order = real[np.lexsort((real, -mass[real], cls[real]))]
    size = np.bincount(cls[real], minlength=CLASSES)
    rank = np.empty(UNITS, np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    depth = 1 + (size > BRANCH) + (size > BRANCH**2)
    node, branch = np.full((UNITS, 3), -1), np.zeros((UNITS, 3), np.int64)
    first = 0
    for level in range(3):
        of = real[depth[cls[real]] > level]
        below = BRANCH ** (depth[cls[of]] - 1 - level)  # units below one branch
        upper = rank[of] // (below * BRANCH)
        width = np.where(depth > level, -(-size // BRANCH ** np.maximum(depth - level, 0)), 0)
        base = first + np.cumsum(width) - width
        node[of, level] = base[cls[of]] + upper
        branch[of, level] = rank[of] // below % BRANCH
        first += int(width.sum())
    prior, last = np.zeros((first, BRANCH)), np.zeros(first, np.int64)
    for level in range(3):
        of = np.flatnonzero(node[:, level] >= 0)
        np.add.at(prior, (node[of, level], branch[of, level]), mass[of])
        np.maximum.at(last, node[of, level], branch[of, level])
    prior /= np.maximum(prior.sum(axis=1, keepdims=True), 1e-300)
    sums = np.bincount(cls, mass, minlength=CLASSES)
    near = np.arange(UNITS + 1)
    rare = np.argsort(-mass, kind="stable")[OWN:]
    near[rare] = UNITS + 1 + cls[rare]
    return Shape(cls, node, branch, prior, last, sums / max(sums.sum(), 1e-300), near)


def _choice_counts(shape):
    """Counts of classes by feature row, and of branches by row of choices."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        s = shape.value
        by_class, by_node = np.zeros(sum(ROWS) * CLASSES, np.int64), np.zeros(NODE_ROWS * BRANCH, np.int64)
        for _, units, edge in _unit_slices(batches, 1 << 20):
            one, two = _contexts(units, edge)
            cls = s.cls[units]
            for rows in _feature_rows(one, two):
                by_class += np.bincount(rows * CLASSES + cls, minlength=len(by_class))
            near = s.near[one]
            for level in range(3):
                at = np.flatnonzero(s.node[units, level] >= 0)
                if len(at):
                    rows = _node_rows(near[at], s.node[units[at], level])
                    by_node += np.bincount(rows * BRANCH + s.branch[units[at], level], minlength=len(by_node))
        return np.concatenate([by_class, by_node])

    return sums


def _logits(rows: list[np.ndarray], bias: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logits of the classes, within bounds that float32 exponentials bear."""
    x = weights.take(rows[0], axis=0)
    x += weights.take(rows[1], axis=0)
    x += weights.take(rows[2], axis=0)
    x += bias
    return x


def _bias(shape: Shape) -> np.ndarray:
    return np.log(np.maximum(shape.class_prior, 1e-30)).astype(np.float32)


def _gradient(model):
    """Expected minus observed classes by feature row, in whole units of 1 / SCALE."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        shape, weights = model.value
        bias, column = _bias(shape), np.arange(CLASSES)
        out = np.zeros(weights.size)  # sums of whole numbers are exact up to 2^53
        for _, units, edge in _unit_slices(batches, 1 << 18):
            one, two = _contexts(units, edge)
            rows, cls = _feature_rows(one, two), shape.cls[units]
            for k in range(0, len(units), STEP):
                some = [r[k : k + STEP] for r in rows]
                x = np.exp(_logits(some, bias, weights))
                x *= np.float32(SCALE) / x.sum(axis=1, keepdims=True)
                g = np.rint(x, out=x).astype(np.float64).reshape(-1)
                g[np.arange(len(x)) * CLASSES + cls[k : k + STEP]] -= SCALE
                for r in some:
                    np.add.at(out, (r[:, None] * CLASSES + column).reshape(-1), g)
        return out.astype(np.int64)

    return sums


def first_weights(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Where training starts: of each feature a third of its rows' smoothed log ratios."""
    weight = np.repeat(PRIOR, ROWS)[:, None]
    share = (counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight)
    return np.clip(np.log(share / np.maximum(prior, 1e-30) + 1e-30) / 3 * (prior > 0), -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def step(weights: np.ndarray, gradient: np.ndarray, counts: np.ndarray, prior: np.ndarray, part: float) -> np.ndarray:
    """Weights after a round: each moves by its gradient over what it expects to see."""
    n = counts.sum(axis=1, keepdims=True)
    expected = part * (counts + n * prior) / 2 + CALM
    return np.clip(weights - np.clip(RATE * gradient / SCALE / expected, -1, 1), -MOST_WEIGHT, MOST_WEIGHT).astype(np.float32)


def train_model(train: DataFrame, words: Words, mass: np.ndarray, total: int = 0) -> Model:
    """The model from ``train`` (part, units) of ``total`` tokens: classes, choices, then rounds of gradient steps."""
    tasks = total // TASK_TOKENS
    spark = train.sparkSession
    own = np.arange(FORMS, FORMS + words.own)
    end = words.table.get(np.array([END]))[0] + FORMS
    beacon = own[own != end][:BEACONS]
    units = train.select("units")
    shape = shape_of(classes(_summed(units, _beside(beacon), UNITS * BEACONS, tasks)), mass)
    counts = _summed(units, _choice_counts(spark.sparkContext.broadcast(shape)), sum(ROWS) * CLASSES + NODE_ROWS * BRANCH, tasks)
    by_class = counts[: sum(ROWS) * CLASSES].reshape(-1, CLASSES)
    by_node = counts[sum(ROWS) * CLASSES :].reshape(-1, BRANCH)
    weights = first_weights(by_class, shape.class_prior)
    for a, b in ROUNDS:
        some = train.filter((F.col("part") >= a) & (F.col("part") < b)).select("units")
        gradient = _summed(some, _gradient(spark.sparkContext.broadcast((shape, weights))), by_class.size, tasks * (b - a) // PARTS)
        weights = step(weights, gradient.reshape(by_class.shape), by_class, shape.class_prior, (b - a) / PARTS)
    return Model(shape, weights, by_node.astype(np.float32), by_node.cumsum(axis=1).astype(np.float32))


def unit_logs(model: Model, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 P(unit | the two units before)."""
    shape, bias = model.shape, _bias(model.shape)
    rows, cls = _feature_rows(one, two), shape.cls[units]
    out = np.empty(len(units))
    for k in range(0, len(units), STEP):
        x = _logits([r[k : k + STEP] for r in rows], bias, model.weights)
        here = x[np.arange(len(x)), cls[k : k + STEP]].astype(np.float64)
        out[k : k + STEP] = here - np.log(np.exp(x).sum(axis=1))
    near = shape.near[one]
    for level in range(3):
        at = np.flatnonzero(shape.node[units, level] >= 0)
        if len(at):
            node, branch = shape.node[units[at], level], shape.branch[units[at], level]
            r = _node_rows(near[at], node)
            share = (model.node_counts[r, branch] + NODE_PRIOR * shape.prior[node, branch]) / (model.node_upto[r, shape.last[node]] + NODE_PRIOR)
            out[at] += np.log(np.maximum(share, 1e-300))
    return out / np.log(10)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part, units, edge in _unit_slices(batches, 1 << 18):
            log = unit_logs(m, units, *_contexts(units, edge))
            yield pa.RecordBatch.from_arrays([*part.drop_columns(["units"]).columns, pa.array(np.add.reduceat(log, edge[:-1]))], [*part.drop_columns(["units"]).schema.names, "log"])

    return run


def score_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Trains on all rows that are not ``held_out`` (by default crc32 of the id, modulo 10,
    is 0). base_score sums log10 of smoothed unigram shares, score is the model's log10
    probability of the text with its end.

    Defined results: a null or empty text is its end alone; rows with a null id are held
    out; repeated rows are each scored and, if in training, each counted; without
    training texts every count is 0; further columns are not read; an empty table
    gives an empty result. Scores depend neither on the partitioning nor on the order of
    the rows, but for the last digits of their sums.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = id_remainder("id", 10) == 0 if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.filter(~held).select("text").mapInArrow(_counts, "h long, form int, c long")
    vocabulary = scratch.table(counted.groupBy("h").agg(F.sum("c").alias("c"), F.min("form").alias("form")), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("words")).collect()[0]
    total, n_words = int(size["total"]), int(size["words"])
    log_all = float(np.log10(total + 0.1 * (n_words + 1)))
    words, mass = known_words(vocabulary)
    kind = rows.schema["id"].dataType.simpleString()
    parted = rows.withColumn("part", F.when(held, -1).otherwise(F.pmod(F.xxhash64("id", "text"), F.lit(PARTS))).cast("int"))
    fields = f"row long, id {kind}, part int, n long, base double, share double, known long"
    encoder = _encoder(spark.sparkContext.broadcast(words), log_all)
    near = scratch.table(parted.mapInArrow(encoder, f"{fields}, far array<long>, units binary"), "near")
    model = train_model(near.filter("part >= 0").select("part", "units"), words, mass, total)
    scorer = _scorer(spark.sparkContext.broadcast(model))
    scored = near.drop("far").mapInArrow(scorer, f"{fields}, log double")
    # words without a broadcast count: their counts by a join, then one row for each text
    far = near.select("row", F.explode("far").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    met = scratch.table(far, "far").join(vocabulary, "h", "left")
    log = F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("far_log")
    settled = met.groupBy("row").agg(log, F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("far_known"))
    out = scored.join(settled, "row", "left")
    more = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("log") + F.col("share") + more).alias("score"),
    )
