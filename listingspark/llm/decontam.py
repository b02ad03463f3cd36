"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are the stated query set; documents are all rows. Items come in blocks of
bounded size, and each block is broadcast to one scan of the documents. A seed is two words
of an item that follow each other or have one word between. A document meets an
item where it holds enough of the item's seeds, so as well with a word between or none.
Around its seeds the document is aligned with the item by words, and the best local
alignment over the item's best possible one is the score, so that edited and paraphrased
copies count as well as exact ones.

The seeds reach every alignment. One of L words that scores least * 2L with m matches has
x = 2m - 2 least L mismatches and gaps at most. If k of the m - 1 steps from match to match
cost one or none, then x >= 2 (m - 1 - k), so k >= least L - 1; each such step is a seed with
a word of its own to start from. So an item may leave out the commonest places to start
from, as long as fewer than least L - 1 go, and what a document must hold is the rest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch

U = np.uint64
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of a block, which bounds what is broadcast; more items mean more scans.
BLOCK_ITEMS = 20_000
#: Items under so many words have to occur whole.
SHORT = 3
#: Places of an item are left out of its seeds if chance brings about theirs more often than this at a word.
RARE = 1e-7
#: Distinct words of items that one scan counts, at most; with more, each block has its own.
COUNTED_WORDS = 1 << 22
LEAST_SCORE = 0.5


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and where it ends in ``text``."""
    n = len(text)
    steps = -GAP * np.arange(n + 1)
    prev = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = np.maximum(prev[:-1] + np.where(text == w, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(row, 0, out=row)
        # a run of gaps along the row: the running maximum of what it started from
        prev = np.maximum.accumulate(row + steps) - steps
        k = int(prev.argmax())
        if prev[k] > best:
            best, end = int(prev[k]), k
    return best, end


def pairs(h: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each word with the one ``apart`` places on."""
    return H.fold([h[:-apart], h[apart:]]) if len(h) > apart else h[:0]


class Items:
    """One block of items, ready to be broadcast."""

    def __init__(self, ids: list, texts: list[str | None], word_share: dict[int, float] | None, rare: float, least: float):
        h, at, _, _ = H.words(pa.array(texts, pa.string()), letters=True)
        self.ids, self.words, self.need, self.least = [], [], [], least
        grams, owner, self.short = [], [], {}
        for i, a, b in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
            w = h[a:b]
            if not len(w):
                continue
            if len(w) < SHORT:
                self.short.setdefault(len(w), []).append((int(H.shingles(w, len(w))[0]), len(self.ids)))
                need = 1
            else:
                share = np.array([word_share.get(int(x), 0.0) for x in w]) if word_share else np.zeros(len(w))
                next_, after = np.append(share[1:], 0.0), np.append(share[2:], [0.0, 0.0])
                odds = (share * np.maximum(next_, after))[:-1]
                steps = max(1, int(np.ceil(least * len(w) - 1 - 1e-9)))
                common = np.argsort(-odds, kind="stable")[: steps - 1]
                common = common[odds[common] > rare]
                need = steps - len(common)
                starts = np.ones(len(w) - 1, bool)
                starts[common] = False
                both = [pairs(w, 1)[starts], pairs(w, 2)[starts[:-1]]]
                found = np.unique(np.concatenate(both))
                grams.append(found)
                owner.append(np.full(len(found), len(self.ids)))
            self.ids.append(i)
            self.words.append(w)
            self.need.append(need)
        flat = np.concatenate(grams) if grams else np.zeros(0, U)
        order = np.argsort(flat, kind="stable")
        self.seeds = H.Members(flat)
        self.first, self.end = np.searchsorted(flat[order], self.seeds.keys), np.searchsorted(flat[order], self.seeds.keys, side="right")
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.need = np.array(self.need, np.int64)
        self.spans = np.array([int(len(w) * (3 - 2 * least)) + 1 for w in self.words], np.int64)

    def windows(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, first word, end word) of the parts of texts that hold enough seeds of an item."""
        met_pos, met_item = [], []
        for apart in (1, 2):
            pos, key = self.seeds.find(pairs(h, apart))
            row = np.searchsorted(at, pos, side="right") - 1
            inside = pos + apart < at[row + 1]
            pos, key = pos[inside], key[inside]
            n = self.end[key] - self.first[key]
            each = np.repeat(np.cumsum(n) - n, n)
            met_pos.append(np.repeat(pos, n))
            met_item.append(self.owner[np.repeat(self.first[key], n) + np.arange(int(n.sum())) - each])
        pos, item = np.concatenate(met_pos), np.concatenate(met_item)
        out = []
        if len(pos):
            both = np.unique(np.stack([item, pos]), axis=1)
            item, pos = both
            row = np.searchsorted(at, pos, side="right") - 1
            # the need-th seed from here on: of the same item and text, and within an alignment's length
            later = np.arange(len(pos)) + self.need[item] - 1
            good = later < len(pos)
            later = np.minimum(later, len(pos) - 1)
            good &= (item[later] == item) & (row[later] == row) & (pos[later] - pos <= self.spans[item])
            for k in np.flatnonzero(good).tolist():
                r, i = int(row[k]), int(item[k])
                lo, hi = max(int(at[r]), int(pos[k] - self.spans[i])), min(int(at[r + 1]), int(pos[later[k]] + self.spans[i]) + 3)
                if out and out[-1][:2] == (r, i) and lo <= out[-1][3]:
                    out[-1] = (r, i, out[-1][2], max(hi, out[-1][3]))
                else:
                    out.append((r, i, lo, hi))
        for size, items in self.short.items():
            whole = H.shingles(h, size) if len(h) >= size else h[:0]
            for key, i in items:
                for p in np.flatnonzero(whole == U(key)).tolist():
                    r = int(np.searchsorted(at, p, side="right")) - 1
                    if p + size <= at[r + 1]:
                        out.append((r, i, p, p + size))
        return out

    def leaks(self, column: pa.Array, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, end word) of the best alignment for each row and item."""
        h, at, _, _ = H.words(column, letters=True)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for r, i, lo, hi in self.windows(h, at):
            item, window = self.words[i], h[lo:hi]
            if np.isin(item, window).mean() < least:
                continue
            points, end = align(item, window)
            score = points / (MATCH * len(item))
            if score >= least and score > best.get((r, i), (0.0,))[0]:
                best[r, i] = (score, lo + max(0, end - len(item)) - int(at[r]), lo + end - int(at[r]))
        return [(*k, *v) for k, v in sorted(best.items())]


def word_shares(scratch: Scratch, docs: DataFrame, words: np.ndarray, text_col: str) -> dict[int, float]:
    """Share of each of the hashed ``words`` among all words of ``docs``, in one scan."""
    known = docs.sparkSession.sparkContext.broadcast(H.Members(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = known.value
        counts, total = np.zeros(len(members.keys), dtype=np.int64), 0
        for whole in batches:
            for batch in H.chunks(whole, "text"):
                h = H.words(batch.column("text"), letters=True)[0]
                counts += np.bincount(members.find(h)[1], minlength=len(counts))
                total += len(h)
        some = np.flatnonzero(counts)
        words = np.concatenate([members.keys[some].view(np.int64), np.zeros(1, np.int64)])
        last = np.concatenate([np.zeros(len(some), bool), np.ones(1, bool)])
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.append(counts[some], total)), pa.array(last)], ["word", "n", "total"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long, total boolean")
    with scratch.small_batches():  # at most one row for each of the words
        rows = counted.groupBy("word", "total").agg(F.sum("n").alias("n")).collect()
    total = max(1, sum(r["n"] for r in rows if r["total"]))
    return {r["word"] & (1 << 64) - 1: r["n"] / total for r in rows if not r["total"]}


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(H.words(batch.column("text"), letters=True)[0]).view(np.int64))], ["word"])


def _blocks(scratch: Scratch, docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text_col: str, rare: float, least: float) -> Iterator[Items]:
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    n = max(1, -(-rows.count() // BLOCK_ITEMS))

    def hashes(some: DataFrame) -> DataFrame:
        return some.select("text").mapInArrow(_word_hashes, "word long").distinct()

    def shares(some: DataFrame) -> dict[int, float]:
        return word_shares(scratch, docs, hashes(some).toArrow()["word"].to_numpy().view(U), text_col)

    share = shares(rows) if n == 1 or hashes(rows).limit(COUNTED_WORDS + 1).count() <= COUNTED_WORDS else None
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        found = block.distinct().orderBy("item", "text").collect()
        yield Items([r["item"] for r in found], [r["text"] for r in found], shares(block) if share is None else share, rare, least)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rare: float = RARE,
    least: float = LEAST_SCORE,
) -> DataFrame:
    """(id_col, item_id, score, first_word, end_word): every document that leaks an item.

    The score is 1 for an exact copy; rows have ``least`` or more, and none is missed. Words are runs of
    letters and digits, with A-Z lower-cased. first_word and end_word (exclusive) place the alignment
    among the document's words.

    Defined results: null and empty documents and items leak nothing; an item of one or
    two words leaks where it occurs whole; texts of any length are read whole; repeated rows of documents give repeated results, repeated
    items do not; item ids that are null stay null in the result; further columns are
    not read; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {item_type}, score double, first_word long, end_word long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(scratch, docs, items, item_id, item_text, text_col, rare, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in H.chunks(whole, "text"):
                    hits = shared.value.leaks(batch.column("text"), least)
                    if not hits:
                        continue
                    ids = batch.column("id").take(pa.array([x[0] for x in hits], pa.int64()))
                    names = pa.array([shared.value.ids[x[1]] for x in hits])
                    rest = [pa.array([x[k] for x in hits]) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids, names, *rest], ["id", "item", "score", "first_word", "end_word"])

        found = found.unionAll(rows.mapInArrow(run, schema))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "score", "first_word", "end_word")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rare: float = RARE,
    least: float = LEAST_SCORE,
) -> DataFrame:
    """``docs`` without the rows that leak an item, in one scan for each block of items.

    All columns pass through. Defined results are those of ``find_leaks``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    out = docs
    for block in _blocks(scratch, docs, items, item_id, item_text, text_col, rare, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in H.chunks(whole, text_col):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[x[0] for x in shared.value.leaks(batch.column(text_col), least)]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
