"""Connected components by star contraction, against a plain union-find."""

import random

import pytest

from listingspark.llm import components
from listingspark.llm.common import Scratch


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("block", [500_000, 1])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_EDGES", block)  # 1: the driver goes on to the star rounds
    rng = random.Random(block)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5, x) for x in range(2000, 2060)]
    loose = [(rng.randrange(0, 300), rng.randrange(0, 300)) for _ in range(140)]
    edges = chain + star + loose + [(7, 7), (None, 3), (9, None)] + chain[:5]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = components.connected_components(Scratch(spark, "cc"), df)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == brute(edges)
    assert components.connected_components(Scratch(spark, "cc"), df.limit(0)).count() == 0
