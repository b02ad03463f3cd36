"""Document statistics, tree growing and scoring against plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listingspark.llm import quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality.FEATURES)
    raw = WORD.findall(data)
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw]
    n, size, counts = len(words), len(data), Counter(words)
    lines = data.count(b"\n") + 1
    pairs = list(zip(words, words[1:]))

    def share(hit):
        return sum(1 for c in data if hit(c)) / size

    out = {
        "words": math.log1p(n),
        "chars": math.log1p(size),
        "word_length": sum(map(len, words)) / max(n, 1),
        "upper": share(lambda c: 65 <= c <= 90),
        "digits": share(lambda c: 48 <= c <= 57),
        "points": share(lambda c: c in b".,;:?'\"-"),
        "stops": share(lambda c: c == ord(".")),
        "shouts": share(lambda c: c == ord("!")),
        "symbols": share(lambda c: c in b"#*$%&<>@^~_=+"),
        "bars": share(lambda c: c == ord("|")),
        "brackets": share(lambda c: c in b"()[]{}"),
        "beyond_ascii": share(lambda c: c > 127),
        "spaces": share(lambda c: c == 32 or 9 <= c <= 13),
        "lines": math.log1p(lines),
        "line_words": n / lines,
        "distinct_words": len(counts) / n if n else 0.0,
        "top_word": max(counts.values()) / n if n else 0.0,
        "twins": sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0,
        "distinct_pairs": len(set(pairs)) / len(pairs) if pairs else 0.0,
        "long_words": sum(len(w) > 18 for w in words) / max(n, 1),
        "short_words": sum(len(w) < 3 for w in words) / max(n, 1),
    }
    return [out[f] for f in quality.FEATURES]


ODD = [None, "", " ", "\n\n", "a", "A! é", "w " * 3000, "x" * 4000, "One two ONE two.\nThree|(four) 5% \x0b#six\x85seven\n", "\x1c \x1f", "da da da\tda", "日本 語 日本 語", "-" * 19 + " ab"]


def some_texts(seed, n):
    rng = np.random.default_rng(seed)
    pieces = ["Word", "word", "a", "of", "It", "42", "!!", "x|y", "(z)", "é", "\n", "\t", "end.", "internationalisation-ness", "<b>", "same", "same"]
    return [" ".join(rng.choice(pieces, int(rng.integers(0, 60)))) for _ in range(n)]


def test_statistics_equal_plain_loops():
    texts = ODD + some_texts(1, 120)
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(quality.statistics(pa.array(texts, pa.string())), want, rtol=1e-12, atol=1e-15)
    # rows of a slice count from the slice's own bytes
    assert np.allclose(quality.statistics(pa.array(texts, pa.string()).slice(5, 40)), want[5:45], rtol=1e-12, atol=1e-15)


def plain_score(trees, row):
    total = trees.base
    for f, t, v in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist()):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - (2**trees.depth - 1)]
    return 1 / (1 + math.exp(-total))


def plain_grow(x, y, trees, depth, bins, rate=0.15, penalty=1.0, least=1.0):
    """Scores of the training rows: every cut of every column tried by adding up its rows."""
    n = len(y)
    mean = (sum(y) + 0.5) / (n + 1)
    total = [math.log(mean / (1 - mean))] * n
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in total]
        groups = [list(range(n))]
        for _ in range(depth):
            split = []
            for rows in groups:
                best, where = 1e-9, None
                g_all, w_all = sum(p[r] - y[r] for r in rows), sum(p[r] * (1 - p[r]) for r in rows)
                for k, cuts in enumerate(edges):
                    for t in cuts:
                        left = [r for r in rows if x[r, k] <= t]
                        g, w = sum(p[r] - y[r] for r in left), sum(p[r] * (1 - p[r]) for r in left)
                        if w >= least and w_all - w >= least:
                            gain = g * g / (w + penalty) + (g_all - g) ** 2 / (w_all - w + penalty) - g_all**2 / (w_all + penalty)
                            if gain > best:
                                best, where = gain, (k, t)
                k, t = where or (0, math.inf)
                split += [[r for r in rows if x[r, k] <= t], [r for r in rows if x[r, k] > t]]
            groups = split
        for rows in groups:
            g, w = sum(p[r] - y[r] for r in rows), sum(p[r] * (1 - p[r]) for r in rows)
            for r in rows:
                total[r] -= rate * g / (w + penalty)
    return [1 / (1 + math.exp(-v)) for v in total]


@pytest.mark.parametrize(("n", "depth", "bins"), [(160, 3, 8), (90, 2, 16), (12, 4, 64)])
def test_trees_equal_plain_loops(n, depth, bins):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.random(n), np.ones(n)])
    y = np.clip(0.5 + 0.3 * x[:, 0] - 0.1 * x[:, 1] + 0.2 * rng.normal(size=n), 0.01, 0.99)  # no two cuts gain the same
    grown = quality.grow(x, y, trees=6, depth=depth, bins=bins)
    assert np.allclose(grown.score(x), plain_grow(x, y, 6, depth, bins), rtol=1e-9)
    fresh = np.column_stack([rng.normal(size=50), rng.integers(-1, 6, 50), rng.random(50), np.zeros(50)])
    assert np.allclose(grown.score(fresh), [plain_score(grown, r) for r in fresh], rtol=1e-12)


def test_scores_of_a_table_equal_a_plain_version(spark):
    texts = ODD + some_texts(2, 80)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (20, "repeated id, other text"), (None, "no id")]
    labels = [(i, i * 7 % 3 % 2) for i in range(len(texts))] + [(4, 1), (4, 0), (6, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, y string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(docs, marks).collect()

    def held(i):
        return i is None or zlib.crc32(str(i).encode()) % 5 == 0

    train = sorted((i, y, plain_statistics(t)) for i, t in rows for k, y in labels if i is not None and i == k and y is not None and not held(i))
    trees = quality.grow(np.array([x for _, _, x in train]), np.array([y for _, y, _ in train], dtype=float))
    want = sorted((i is None, i or 0, held(i), round(plain_score(trees, plain_statistics(t)), 9)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) for r in got) and len({w[3] for w in want}) > 20
