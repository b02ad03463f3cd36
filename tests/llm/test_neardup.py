"""Near-duplicate groups against brute force, and the helpers below them."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listingspark.llm import texthash as H
from listingspark.llm.neardup import near_duplicates, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words_of(text)
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA bé\n\t\xa0Z\x1c", max_size=12)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_match_the_pattern(texts):
    column = pa.array(texts, pa.string())
    h, at, a, b = H.words(column)
    blob = "".join(x or "" for x in texts).encode()
    got = [[blob[a[i] : b[i]].decode() for i in range(at[r], at[r + 1])] for r in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    seen = {}
    for i in range(len(h)):
        w = blob[a[i] : b[i]].lower()
        assert seen.setdefault(w, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_words_over_windows(monkeypatch):
    text = ["ab cd " * 40, "x" * 100, "", "ef " * 30 + "gh", "y" * 50 + " z"]
    whole = H.words(pa.array(text))
    monkeypatch.setattr(H, "WINDOW", 16)
    cut = H.words(pa.array(text))
    for p, q in zip(whole, cut, strict=True):
        assert np.array_equal(p, q)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = e[:2000], e[500:2500]  # similarity 0.6
    sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 2000), 2, 120)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    small = superminhash(e[:3], np.array([0, 0, 1]), 3, 120)
    assert (small[2] == np.iinfo(np.uint64).max).all() and (small[:2] < np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, k, num):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(2, 90))))
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(vocabulary))
            base = text if rng.random() < 0.5 else base  # drifting copies make chains
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "w " * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = near_duplicates(docs, shingle=k, similarity=(num, 100))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(rows, k, num, 100)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0
