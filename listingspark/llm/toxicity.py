"""Toxicity: Levenshtein automata over a lexicon trie, weighed by their context.

The lexicon is learned from labelled texts: words, and stems that words begin with, that
toxic texts hold far more often than chance allows. Every word of a text is looked up by
running its Levenshtein automaton along the lexicon's trie, which finds misspelled terms
as well. Each find is weighed by the words around it, learned from the same labels, so
that quotation and abuse part, and the finds of a text add up to its score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch, id_remainder
from listingspark.llm.quality import sampled

#: Labelled rows that the lexicon and the contexts are learned from, at most about so many.
SAMPLE = 20_000
#: Lengths of stems.
STEMS = range(4, 9)
#: Slots for words that a Python worker knows to be no find, and finds that it keeps.
SLOTS, FINDS = 1 << 21, 500_000
#: Letters from which a term may be two edits off, and from which swapped neighbours are one edit.
LONG, SWAPS = 8, 7
WINDOW = 3
#: What each further find of a text counts, as a share of the one before it.
FADE = 0.7
#: Texts that the weight of an exact find counts as for the misspelled finds of its term.
EDIT_PRIOR = 2.0
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-|/\\`~#$%&+=@^«»“”„‘’…¡¿"
OPENING, CLOSING = "\"'«“„‘", "\"'»”’"
_LOOKALIKE = str.maketrans("013457@$", "oleastas")


def bare(word: str) -> str:
    """A word in lower case without the punctuation around it."""
    return word.strip(PUNCTUATION).lower()


def allowed(length: int) -> int:
    """Edits that a term of so many letters may be off."""
    return 0 if length < 5 else 1 if length < LONG else 2


def shorter(word: str, most: int = 1) -> set[str]:
    """All forms of a word with one letter less, or with up to ``most`` letters less."""
    forms = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return forms if most == 1 else forms | {x for f in forms for x in shorter(f, most - 1)}


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: int = -1
    stem: bool = False


_BASE = H.U(0x9E3779B97F4A7C15)
_BACK, _BACK2 = (H.U(pow(0x9E3779B97F4A7C15, -k, 1 << 64)) for k in (1, 2))


def beginnings(words: list[str], n: int) -> np.ndarray:
    """Hashes of the first 0, 1 ... n letters of words with n letters and more, words x (n + 1)."""
    codes = np.frombuffer("".join(w[:n] for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
    out = np.zeros((len(words), n + 1), H.U)
    np.cumsum(H.mix(codes.astype(H.U) + H.U(0x51ED270B)) * np.cumprod(np.full(n, _BASE)), axis=1, out=out[:, 1:])
    return out


def shortened(begin: np.ndarray, n: int, most: int) -> Iterator[np.ndarray]:
    """Hashes of the first n letters of words with none, one ... ``most`` (two at most) of them left out."""
    whole = begin[:, n : n + 1]
    yield whole
    if most:
        yield begin[:, :n] + (whole - begin[:, 1 : n + 1]) * _BACK
    if most > 1:
        for p in range(n - 1):
            yield begin[:, p : p + 1] + (begin[:, p + 1 : n] - begin[:, p + 1 : p + 2]) * _BACK + (whole - begin[:, p + 2 : n + 1]) * _BACK2


@dataclass
class Lexicon:
    """Terms with their weights, as a trie; a stem is a term that words may go on from."""

    terms: list[str]
    stems: list[bool]
    weights: list[float]
    base: float
    context: dict[str, float]
    edited: dict[tuple[int, int], float] = field(default_factory=dict)  # weights of misspelled finds, by term and edits
    scale: list[float] | None = None  # of a text's measures, from the labels
    none: float | None = None  # log odds of a text without finds
    root: Node = field(default_factory=Node)  # terms under SWAPS letters
    long_root: Node = field(default_factory=Node)
    finds: dict[int, tuple[int, int]] = field(default_factory=dict)  # a worker's finds, by the word's hash
    others: np.ndarray | None = None  # hashes of words that are no finds, one for each slot

    def __post_init__(self):
        for i, (t, s) in enumerate(zip(self.terms, self.stems, strict=True)):
            at = self.long_root if len(t) >= SWAPS else self.root
            for c in t:
                at = at.next.setdefault(c, Node())
            at.term, at.stem = i, s
        # words within so many edits of each other, swaps included, have a common form with at
        # most as many letters less in either; the automaton is run on words that have one only
        forms = [x.reshape(-1) for t in self.terms for x in shortened(beginnings([t], len(t)), len(t), allowed(len(t)))]
        self.forms = H.Members(np.concatenate(forms) if forms else np.zeros(0, H.U))
        self.longest = max(map(len, self.terms), default=0)
        self.edits = allowed(self.longest)
        stems = [t for t, s in zip(self.terms, self.stems, strict=True) if s]
        self.stem_sizes = sorted({len(t) for t in stems})
        self.stem_forms = H.Members(np.array([beginnings([t], len(t))[0, -1] for t in stems], H.U))
        near = {(k + d, allowed(k)) for k in self.stem_sizes if allowed(k) for d in range(-allowed(k), allowed(k) + 1)}
        self.prefixes = sorted((k, max(e for n, e in near if n == k)) for k in {n for n, _ in near})
        #: letters of a word that count: further ones are only ever what goes on from a stem
        self.reach = max([self.longest + self.edits + 1, *(k + 1 for k, _ in self.prefixes)])

    def likely(self, word: str) -> bool:
        return bool(self.likely_words([word])[0])

    def likely_words(self, words: list[str]) -> np.ndarray:
        """Whether the automaton could meet a term, for each word: never false where it would."""
        out = np.zeros(len(words), bool)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(min(len(w), self.reach), []).append(i)
        for n, found in by_size.items():
            at, begin = np.array(found), beginnings([words[i] for i in found], n)

            def meets(members: H.Members, hashes: Iterator[np.ndarray]) -> None:
                nonlocal at, begin
                hit = np.zeros(len(at), bool)
                for h in hashes:
                    hit[members.find(h.reshape(-1))[0] // h.shape[1]] = True
                out[at[hit]] = True
                at, begin = at[~hit], begin[~hit]

            for k in self.stem_sizes:
                if k <= n:
                    meets(self.stem_forms, iter([begin[:, k : k + 1]]))
            if n <= self.longest + self.edits:
                meets(self.forms, shortened(begin, n, 2 if self.edits > 1 and n >= LONG - 2 else 1))
            for k, edits in self.prefixes:
                if n >= 5 and n > k:
                    meets(self.forms, shortened(begin, k, edits))
        return out

    def look_up(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within the allowance of word and term, or None.

        Walks the tries with the automaton of the word: a state is the row of edit
        distances between the trie's path and every prefix of the word; a path whose
        row holds nothing within the allowance is left. A stem is met where the row is
        within the allowance for some prefix of the word. For terms of SWAPS letters and
        more, swapped neighbours are one edit.
        """
        allow = 0 if len(word) < 5 else self.edits
        word = word[: self.reach]
        best: tuple[int, int] | None = None
        for root, swaps in ((self.root, False), (self.long_root, True)):
            stack = [(root, list(range(len(word) + 1)), None, "")]
            while stack:
                node, row, before, path = stack.pop()
                if node.term >= 0:
                    edits = min(row) if node.stem else row[-1]
                    if edits <= min(allow, allowed(len(path))) and (best is None or edits < best[1]):
                        best = (node.term, edits)
                for c, below in node.next.items():
                    step = [row[0] + 1]
                    for k, w in enumerate(word, 1):
                        d = min(row[k] + 1, step[k - 1] + 1, row[k - 1] + (w != c))
                        if swaps and before and k > 1 and w == path[-1] and word[k - 2] == c:
                            d = min(d, before[k - 2] + 1)
                        step.append(d)
                    if min(step) <= allow:
                        stack.append((below, step, row, path + c))
        return best

    def find(self, word: str) -> tuple[int, int] | None:
        """``look_up`` of a word as it stands in a text, lookalike digits included."""
        return self.find_all([word])[0]

    def find_all(self, words: list[str]) -> list[tuple[int, int] | None]:
        """``find`` of many words at once."""
        plain = [bare(w) for w in words]
        out: list[tuple[int, int] | None] = [None] * len(words)
        use = [i for i, w in enumerate(plain) if len(w) >= 3]
        for i, ok in zip(use, self.likely_words([plain[i] for i in use]), strict=True):
            if ok:
                out[i] = self.look_up(plain[i])
        changed = [(i, plain[i].translate(_LOOKALIKE)) for i in use if out[i] is None and not plain[i].isalpha()]
        changed = [(i, w) for i, w in changed if w != plain[i] and w.isalpha()]
        for (i, w), ok in zip(changed, self.likely_words([w for _, w in changed]), strict=True):
            hit = self.look_up(w) if ok else None
            if hit and hit[1] == 0:
                out[i] = (hit[0], 1)
        return out

    def spotted(self, column: pa.Array) -> Iterator[tuple[int, list[str], dict[int, tuple[int, int]]]]:
        """(row, its words, finds by the place of their word) for each text of a column with finds.

        Each distinct word is looked up once in a worker, as far as its slots hold it.
        """
        if self.others is None:
            self.others = np.zeros(SLOTS, H.U)
        data, at = H.buffers(column)
        h, rows, a, b = H.words(column)
        if not len(h):
            return
        begin = int(at[0])
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        slot = (unique >> H.U(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        new = [k for k in np.flatnonzero(self.others[slot] != unique).tolist() if int(unique[k]) not in self.finds]
        texts = [data[begin + int(a[i]) : begin + int(b[i])].tobytes().decode() for i in first[new].tolist()]
        kept = {k: self.finds[int(unique[k])] for k in np.flatnonzero(self.others[slot] != unique).tolist() if int(unique[k]) in self.finds}
        for k, hit in zip(new, self.find_all(texts), strict=True):
            if hit is None:
                self.others[slot[k]] = unique[k]
            else:
                kept[k] = hit
        if len(self.finds) > FINDS:
            self.finds.clear()
        self.finds.update((int(unique[k]), hit) for k, hit in kept.items())
        if not kept:
            return
        chosen = np.zeros(len(unique), bool)
        chosen[list(kept)] = True
        tokens = np.flatnonzero(chosen[back])
        owner = np.searchsorted(rows, tokens, side="right") - 1
        for r in np.unique(owner).tolist():
            lo, hi = int(rows[r]), int(rows[r + 1])
            words = [data[begin + int(a[i]) : begin + int(b[i])].tobytes().decode() for i in range(lo, hi)]
            mine = tokens[owner == r]
            yield r, words, {int(t) - lo: kept[int(back[t])] for t in mine}


def features(words: list[str], at: int) -> list[str]:
    """What stands around a word: its neighbours, and whether quotation marks enclose it."""
    near = [bare(w) for w in words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]]
    opened = any(w[:1] in OPENING for w in words[max(0, at - WINDOW) : at + 1])
    ends = (w.rstrip(".,;:!?")[-1:] for w in words[at : at + 1 + WINDOW])
    quoted = opened and any(c and c in CLOSING for c in ends)
    return [f"near {w}" for w in dict.fromkeys(near) if w] + (["quoted"] if quoted else ["plain"])


def _counted(batches: Iterator[pa.RecordBatch], sets: Callable[[pa.Array], Iterator[tuple[int, set[str]]]]) -> Iterator[pa.RecordBatch]:
    """Counts of rows (toxic or not) that hold each key, combined in the task."""
    counts: Counter[tuple[str, int]] = Counter()

    def flush() -> pa.RecordBatch:
        k = list(counts)
        out = [pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int64()), pa.array([counts[x] for x in k], pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["key", "y", "n"])

    for whole in batches:
        for batch in H.chunks(whole, "text", 1 << 20):
            y = batch.column("y").to_pylist()
            for row, keys in sets(batch.column("text")):
                counts.update((k, y[row]) for k in keys)
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def term_keys(text: str) -> set[str]:
    """Every distinct word of a text, and its stems marked by a trailing star."""
    words = {bare(w) for w in text.split()}
    words = {w for w in words if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _term_sets(column: pa.Array) -> Iterator[tuple[int, set[str]]]:
    for row, text in enumerate(column.to_pylist()):
        yield row, term_keys(text or "")


def _placed(batches: Iterator[pa.RecordBatch], wanted: set[str]) -> Iterator[pa.RecordBatch]:
    """Each wanted term with a hash of the words before and after it, distinct in the slice."""
    for whole in batches:
        for batch in H.chunks(whole, "text", 1 << 20):
            found: set[tuple[str, int]] = set()
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                for i, w in enumerate(words):
                    b = bare(w)
                    if len(b) < 3:
                        continue
                    for key in (b, *(b[:k] + "*" for k in STEMS if len(b) >= k)):
                        if key in wanted:
                            around = "\0".join((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
                            found.add((key, zlib.crc32(around.encode())))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["key", "place"])


def learn(train: DataFrame) -> Lexicon:
    """A lexicon from rows (text, y), y 1 for toxic.

    A term stays if it occurs in toxic texts so often, and in others so seldom, that
    chance would hardly do it for any of all the terms tried, and if at least six in
    seven texts that hold it are toxic. A stem replaces the words that it covers. Equal
    texts with one label count once (with both labels once for each), and so do finds
    between the same two neighbours. Neither terms nor contexts are capped: what comes to
    the driver is bounded by the sample of labelled rows.
    """
    train = train.dropDuplicates(["text", "y"])
    spark = train.sparkSession
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    empty = Lexicon([], [], [], math.log((bad + 0.5) / (good + bad + 1)) if bad + good else math.log(0.5), {})
    if not bad:
        return empty
    share = bad / (bad + good)

    def counted(y: int, name: str) -> DataFrame:
        keys = train.filter(F.col("y") == y).mapInArrow(lambda b: _counted(b, _term_sets), "key string, y long, n long")
        return keys.groupBy("key").agg(F.sum("n").alias(name))

    toxic = counted(1, "t")
    tried = toxic.agg(F.count("*").alias("n")).collect()[0]["n"]
    # so many toxic texts and no other: less than one term in a hundred runs by chance
    least = max(3, math.ceil(math.log(max(2, tried) * 100) / -math.log(min(0.9, share))))
    met = toxic.filter(F.col("t") >= least).join(counted(0, "n"), "key", "left").select("key", "t", F.coalesce("n", F.lit(0)).alias("n"))
    # what comes to the driver is what toxic texts hold often and others hardly ever
    found = {r["key"]: (r["t"], r["n"]) for r in met.filter("t >= 6 * n").collect()}
    against = {k: n for k, (_, n) in found.items()}
    kept = {k: t for k, (t, n) in found.items() if unlikely(t, n, share, tried)}
    # near copies of one text hold a word between the same neighbours: they count once
    terms_seen = spark.sparkContext.broadcast(set(kept))
    places = train.filter("y = 1").mapInArrow(lambda b: _placed(b, terms_seen.value), "key string, place long")
    apart = {r["key"]: r["n"] for r in places.distinct().groupBy("key").agg(F.count("*").alias("n")).collect()}
    kept = {k: min(t, apart.get(k, 0)) for k, t in kept.items()}
    kept = {k: t for k, t in kept.items() if t >= least and t >= 6 * against[k] and unlikely(t, against[k], share, tried)}

    chosen = covering(kept)
    terms = sorted(chosen, key=lambda k: (-chosen[k], k))
    weights = [math.log((chosen[k] + 0.5) / (against[k] + 0.5)) - math.log((bad + 1) / (good + 1)) for k in terms]
    base = math.log((bad + 0.5) / (good + 0.5))
    lexicon = Lexicon([k.rstrip("*") for k in terms], [k.endswith("*") for k in terms], weights, base, {})

    # what stands around finds in toxic texts and in others
    shared = spark.sparkContext.broadcast(lexicon)

    def around(column: pa.Array) -> Iterator[tuple[int, set[str]]]:
        for row, words, hits in shared.value.spotted(column):
            yield row, {f for i in hits for f in features(words, i)} | {f"find {t} {e}" for t, e in hits.values() if e}

    near = train.mapInArrow(lambda b: _counted(b, around), "key string, y long, n long").groupBy("key", "y").agg(F.sum("n").alias("n"))
    near = near.groupBy("key").pivot("y", [0, 1]).agg(F.sum("n")).na.fill(0)
    seen = near.filter("`0` + `1` > 10 or key like 'find %'").collect()
    # a misspelled find weighs what the labels say of it; few finds lean on the term's own weight
    odds = math.log((bad + 1) / (good + 1))
    for r in (r for r in seen if r["key"].startswith("find ")):
        term, edits = map(int, r["key"].split()[1:])
        ratio = math.exp(0.75 * weights[term] + odds)
        prior = EDIT_PRIOR * ratio / (1 + ratio)
        lexicon.edited[term, edits] = math.log((r["1"] + prior) / (r["0"] + EDIT_PRIOR - prior)) - odds
    seen = [r for r in seen if not r["key"].startswith("find ")]
    sums = [max(1, sum(r[c] for r in seen)) for c in ("0", "1")]
    for r in seen:
        ratio = math.log((r["1"] + 2) / (sums[1] + 4)) - math.log((r["0"] + 2) / (sums[0] + 4))
        if r["0"] >= 10:
            lexicon.context[r["key"]] = max(-2.0, min(1.0, ratio))

    # what the sum of a text's finds says, given its length and their number
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, "text", 1 << 20):
                found = {row: measures(shared.value, words, hits) for row, words, hits in shared.value.spotted(batch.column("text"))}
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([found.get(k) for k in range(batch.num_rows)], pa.list_(pa.float64()))], ["y", "x"])

    rows = train.mapInArrow(measured, "y int, x array<double>").toPandas()
    blank = rows["x"].isna()
    # whatever the labels, a text without a find is not called toxic
    lexicon.none = min(-1.0, math.log((rows["y"][blank].sum() + 0.5) / ((1 - rows["y"][blank]).sum() + 0.5)))
    if not blank.all():
        x, y = np.array(rows["x"][~blank].tolist()), rows["y"][~blank].to_numpy(float)
        order = np.lexsort((*x.T, y))
        lexicon.scale = fitted(x[order], y[order]).tolist()
    return lexicon


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression, a constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def covering(kept: dict[str, int]) -> dict[str, int]:
    """The terms that stand for all of ``kept``.

    From the shortest stem on, a stem covers all terms that begin with it. It gives way
    to a longer stem, or to one whole word, that occurs in nearly as many texts.
    """
    chosen: dict[str, int] = {}
    left = set(kept)
    for k in sorted((k for k in kept if k.endswith("*")), key=lambda k: (len(k), k)):
        if k not in left:
            continue
        family = [x for x in left if x.startswith(k[:-1])]
        left -= set(family)
        near = [x for x in family if kept[x] >= 0.95 * kept[k]]
        best = max(near, key=lambda x: (not x.endswith("*"), len(x), x))
        chosen[best] = kept[best]
    return chosen | {k: kept[k] for k in left}


def unlikely(t: int, n: int, share: float, tried: int) -> bool:
    """Whether ``t`` toxic texts of ``t + n`` are too many for chance among ``tried`` terms.

    The bound of Chernoff on the binomial tail, in logarithms.
    """
    m = t + n
    rate = t / m
    if rate <= share:
        return False
    divergence = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return -m * divergence < -math.log(100 * max(2, tried))


def measures(lexicon: Lexicon, words: list[str], hits: dict[int, tuple[int, int]]) -> list[float]:
    """Of a text with finds: the sum of their weights, the logarithms of its words and of its finds.

    Each term counts once, where its context speaks most for abuse, and each further
    term FADE times what it would as the one before, the greatest first.
    """
    best: dict[int, float] = {}
    n = 0.0
    for i, (term, edits) in hits.items():
        weight = lexicon.weights[term]
        if edits:
            weight = lexicon.edited.get((term, edits), 0.75 * weight)
        n += weight > 1
        weight += max(-3.0, min(1.0, sum(lexicon.context.get(f, 0.0) for f in features(words, i))))
        best[term] = max(best.get(term, 0.0), weight)
    total = sum(w * FADE**k for k, w in enumerate(sorted(best.values(), reverse=True)))
    return [total, math.log(len(words)), math.log1p(n)]


def weigh(lexicon: Lexicon, words: list[str], hits: dict[int, tuple[int, int]]) -> float:
    """Score of a text with finds."""
    x = measures(lexicon, words, hits)
    scale = lexicon.scale or [lexicon.base, 1.0, 0.0, 0.0]
    total = scale[0] + sum(a * b for a, b in zip(scale[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _score(lexicon: Lexicon, text: str) -> tuple[float, int]:
    """Score of a text, and the number of its finds."""
    return _scores(lexicon, pa.array([text], pa.string()))[0]


def _scores(lexicon: Lexicon, column: pa.Array) -> list[tuple[float, int]]:
    """Score and number of finds of each text; a text without a find is seldom toxic."""
    none = lexicon.base - 2 if lexicon.none is None else lexicon.none
    out = [(1 / (1 + math.exp(-none)), 0)] * len(column)
    for row, words, hits in lexicon.spotted(column):
        out[row] = (weigh(lexicon, words, hits), len(hits))
    return out


def train_lexicon(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str, held: Column, sample: int) -> Lexicon:
    """Learns from about ``sample`` labelled rows that are not held out.

    The sampled labels are few enough by their bound to be broadcast to the scan, so that
    texts without one are never shuffled.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y is not null").filter(~held)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return learn(scratch.table(rows.join(F.broadcast(sampled(marked, sample)), "id").select("text", "y"), "train"))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: Column | None = None,
    threshold: float = 0.5,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id_col, held_out, score, predicted, n_finds) for every row of ``docs``.

    Learns from labelled rows that are not ``held_out`` (by default crc32 of the id,
    modulo 5, is 0), about ``sample`` of them at most, by the hash of the id.

    Defined results: null and empty texts have no finds and the score of a text without
    any, which is never 0.5 or more; texts and words of any length are read whole; equal texts with both labels teach
    either; null labels teach nothing; null ids are held out and join no label; an id with
    several labels teaches each of them; repeated rows score alike; without toxic
    labels nothing is predicted toxic; further columns are not read; an empty table
    gives an empty result.
    """
    held = id_remainder("id", 5) == 0 if held_out is None else held_out
    lexicon = train_lexicon(docs, labels, Scratch(docs.sparkSession, "toxicity"), id_col, text_col, label_col, held, sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, "text", 2 << 20):
                found = _scores(shared.value, batch.column("text"))
                out = [batch.column("id"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["id", "score", "n_finds"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, n_finds long")
    return scored.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_finds",
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: Column | None = None,
    threshold: float = 0.5,
    sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` predicts toxic, in one scan."""
    held = id_remainder("id", 5) == 0 if held_out is None else held_out
    lexicon = train_lexicon(docs, labels, Scratch(docs.sparkSession, "toxicity"), id_col, text_col, label_col, held, sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, text_col, 2 << 20):
                yield batch.filter(pa.array([score < threshold for score, _ in _scores(shared.value, batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
