"""Meetings by rare elements against all pairs, and families just under the similarity."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from listingspark.llm import neardup
from tests.llm.test_neardup import brute

SCHEMA = "id long, n int, c long, i int, e long"


def prefixes(sets, component, num, den):
    often = Counter(e for s in sets.values() for e in s)
    rows = []
    for k, s in sets.items():
        ordered = sorted(s, key=lambda e: (often[e], e))
        first = ordered[: len(s) - -(-num * len(s) // den) + 1]
        rows += [(k, len(s), component[k], i, e) for i, e in enumerate(first) if often[e] > 1]
    return rows


def open_pairs(rows, num, den):
    """Pairs that share an element with room for a link on either side, pair by pair."""
    found = set()
    for (a, na, ca, i, e), (b, nb, cb, j, f) in combinations(rows, 2):
        need = -(-num * (na + nb) // (num + den))
        if a != b and ca != cb and e == f and i <= na - need and j <= nb - need:
            found.add((min(a, b), max(a, b)))
    return found


@pytest.mark.parametrize("split", [2, 4096])
@pytest.mark.parametrize("num", [80, 85])
def test_meetings_equal_all_pairs(spark, monkeypatch, split, num):
    monkeypatch.setattr(neardup, "SPLIT", split)
    rng = np.random.default_rng(num + split)
    sets = {}
    for family in range(6):
        core = rng.choice(500, int(rng.integers(5, 60)), replace=False)
        for _ in range(8):
            kept = core[rng.random(len(core)) < rng.choice([0.8, 0.9, 1.0])]
            sets[len(sets) + 1] = {int(x) for x in kept} | {int(x) for x in rng.choice(500, int(rng.integers(1, 6)))} | {1000 + family}
    component = {k: int(rng.integers(0, 12)) for k in sets}
    rows = prefixes(sets, component, num, 100)
    met = {(r.a, r.b) for r in neardup.meetings(spark.createDataFrame(rows, SCHEMA), num, 100).collect()}
    assert met == open_pairs(rows, num, 100) and met
    # every link of sets of different components is among them
    for (a, s), (b, t) in combinations(sets.items(), 2):
        if component[a] != component[b] and 100 * len(s & t) >= num * len(s | t):
            assert (a, b) in met


def test_meetings_of_an_empty_table(spark):
    assert neardup.meetings(spark.createDataFrame([], SCHEMA), 80, 100).count() == 0


def test_a_family_just_under_the_similarity_hardly_meets(spark):
    core = list(range(88))  # 88 common and 13 own elements: similarity 88 / 114
    sets = {k: {*core, *range(1000 * k, 1000 * k + 13)} for k in range(1, 2001)}
    rows = prefixes(sets, {k: k for k in sets}, 80, 100)
    assert len(rows) > 10_000  # each of its common elements would give four million meetings
    assert neardup.meetings(spark.createDataFrame(rows, SCHEMA), 80, 100).count() == 0


def test_one_component_does_not_meet_itself(spark):
    sets = {k: {*range(95), 1000 + k, 5000 + k} for k in range(1, 401)} | {500: {*range(95), 900, 901, 902}}
    rows = prefixes(sets, {k: 500 if k == 500 else 1 for k in sets}, 80, 100)
    met = neardup.meetings(spark.createDataFrame(rows, SCHEMA), 80, 100)
    assert {(r.a, r.b) for r in met.distinct().collect()} == {(k, 500) for k in range(1, 401)}


def test_families_under_the_similarity_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for f in range(3):
        base = [f"b{f}x{i}" for i in range(100)]
        for k in range(60):
            text = list(base)
            for at in rng.choice(100, 3 if k % 3 else 1, replace=False):
                text[int(at)] = f"own{f}x{k}x{at}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == brute(rows, 5, 80, 100)


def test_sets_of_one_size_are_told_by_all_their_elements(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f h"), (3, "A B C D E F G"), (4, "g f e d c b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == brute(rows, 5, 80, 100)
