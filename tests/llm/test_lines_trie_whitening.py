"""Line deduplication, the prefix trie and whitening against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingspark.llm import common
from listingspark.llm.linededup import drop_shared_lines
from listingspark.llm.prefixtrie import hash_ids, join_ids, numbered, prefix_trie, share_heads
from listingspark.llm.queries import op11_line_dedup, op12_conversation_trie, op13_embedding_whitening
from listingspark.llm.whitening import Spectrum, rank_one, whiten

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
digest = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_lines(rows, least=40, documents=5):
    """(id, n_lines, n_dropped, kept text) of rows (id, text), sorted."""
    low = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= least:
                held[key(x)].add(i)
    shared = {k: max(ids, key=low) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, lines in split:
        kept = [x for x in lines if shared.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def cut(df, **more):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in drop_shared_lines(df, **more).collect()), key=repr)


LONG = "A line of Forty code points, or a FEW more É"
EDGES = [
    *[(i, f"own {i}\n \t{LONG}\r\nshort\n{LONG.lower().replace('É', 'É')}") for i in range(1, 8)],
    (9, f"{LONG}\n\n{LONG}\n"), (9, f"{LONG}\n\n{LONG}\n"), (9, "another text of the id\n" + LONG), (None, LONG), (None, LONG + "\n" + LONG),
    (20, None), (21, ""), (22, "\n"), (23, "x" * 39), *[(30 + k, "y" * 40) for k in range(4)], *[(40 + k, "z" * 40 + " ") for k in range(5)],
    *[(50 + k, "İ" * 40) for k in range(5)], (60, "\n".join(f"{LONG}{k % 3}" for k in range(30_000))), *[(61 + k, f"{LONG}1\n{LONG}") for k in range(6)],
]


def test_lines_match_plain_version_on_odd_rows(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"N_Lines": F.lit("x"), "r1": F.lit(1), "gone": F.lit(2), "lines": F.lit(3), "h1": F.lit(4)})
    out = drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "r1", "gone", "lines", "h1", "n_lines", "n_dropped", "kept_text"]
    assert cut(df) == plain_lines(EDGES)
    assert cut(df.repartition(5)) == plain_lines(EDGES)
    assert cut(df.limit(0)) == []
    assert cut(df, least_chars=3, least_documents=2) == plain_lines(EDGES, 3, 2)


def test_lines_without_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_SHARE", 2)
    rng = random.Random(3)
    rows = [(i, "\n".join(f"{rng.randrange(30):040d}" for _ in range(rng.randrange(9)))) for i in range(120)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)


def test_line_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op11_line_dedup(spark, SF).collect()), key=repr)
    assert got == sorted(((i, n, d, digest(t)) for i, n, d, t in plain_lines(rows)), key=repr)


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return convs, {c: convs.get(c - c % 20, [])[: h(c)] + v[h(c) :] for c, v in convs.items()}


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        cost = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += cost
            leaves[k[:d]] += k not in children
    ends = lambda k: digest(",".join(str(c) for c in members[k] if len(convs[c]) == len(k)))
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], ends(k)) for k, m in members.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CHATS = "conv_id long, turn int, role string, text string"


def random_chats(n, seed, longest=12):
    rng = random.Random(seed)
    texts = ["a b", "", None, "c", "d e f\n"]
    rows = [(c, t, rng.choice(["user", None]), rng.choice(texts)) for c in range(n) if c % 7 for t in range(rng.randrange(longest))]
    rows += [(c, None, "system", "s t") for c in range(0, n, 9)] + [(3, t, "user", f"w {t % 2}") for t in range(60)] + [(23, t, "user", f"w {t % 2}") for t in range(60)]
    rows += [(None, 0, "user", "lost"), (41, 1, "user", "tie"), (41, 1, "user", "tie"), (41, 1, "bot", "tie")]
    return rows


@pytest.mark.parametrize(("width", "share"), [(8, 1000), (3, 4), (1, 1000)])
def test_trie_matches_plain_version(spark, monkeypatch, width, share):
    monkeypatch.setattr(common, "HEAVY_SHARE", share)
    rows = random_chats(130, width)
    df = spark.createDataFrame(rows, CHATS).withColumn("block", F.lit(1)).withColumn("first", F.lit("x"))
    whole, rebuilt = plain_rebuilt(rows)
    assert trie_rows(prefix_trie(share_heads(numbered(df)), width)) == plain_trie(rebuilt)
    if width == 3:
        assert trie_rows(prefix_trie(numbered(df), width)) == plain_trie(whole)


def test_trie_of_copies_turnless_and_empty(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100) for t in range(3)]
    _, rebuilt = plain_rebuilt(rows)
    assert trie_rows(prefix_trie(share_heads(numbered(spark.createDataFrame(rows, CHATS))))) == plain_trie(rebuilt)
    turnless = [(c, 0, "user", "x") for c in range(21, 40)]
    _, rebuilt = plain_rebuilt(turnless)
    assert any(not v for v in rebuilt.values())
    assert trie_rows(prefix_trie(share_heads(numbered(spark.createDataFrame(turnless, CHATS))))) == plain_trie(rebuilt)
    assert trie_rows(prefix_trie(share_heads(numbered(spark.createDataFrame([], CHATS))))) == []


def test_ends_of_many_rows_hash_as_one_text():
    import pyarrow as pa

    ids = list(range(0, 90_000, 3))
    batches = [pa.RecordBatch.from_pydict({"k1": [7] * len(x), "k2": [8] * len(x), "depth": [2] * len(x), "conv_id": x}) for x in (ids[:10_000], ids[10_000:])]
    joined = list(join_ids(iter(batches)))
    assert sum(b.num_rows for b in joined) > 2
    assert max(len(v) for b in joined for v in b.column(4).to_pylist()) < 70_000
    (out,) = hash_ids(iter(joined))
    assert out.column(3).to_pylist() == [digest(",".join(map(str, ids)))]


def test_trie_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(op12_conversation_trie(spark, SF)) == plain_trie(plain_rebuilt(rows)[1])


def close(spectrum, rows):
    away = rows - rows.mean(0)
    want = away.T @ away
    got = spectrum.vectors * spectrum.values @ spectrum.vectors.T
    assert np.abs(got - want).max() <= 1e-10 * max(np.abs(want).max(), 1)
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(rows.shape[1])).max() < 1e-10


@pytest.mark.parametrize("kind", ["wide", "ties", "repeats", "axes", "equal", "one", "scales"])
def test_rank_one_updates_follow_the_scatter(kind):
    rng = np.random.default_rng(5)
    rows = {
        "wide": rng.integers(-200, 200, (150, 64)), "ties": rng.integers(-1, 2, (200, 6)), "repeats": np.repeat(rng.integers(-9, 9, (3, 8)), 40, axis=0),
        "axes": np.eye(10, dtype=int) * 7, "equal": np.ones((5, 4), dtype=int), "one": rng.integers(-5, 5, (99, 1)), "scales": rng.integers(-90, 90, (200, 9)) * 10 ** rng.integers(0, 7, 9),
    }[kind].astype(np.int64)
    a, b = Spectrum(rows.shape[1]), Spectrum(rows.shape[1])
    a.add(rows[: len(rows) // 3])
    b.add(rows[len(rows) // 3 :])
    a.merge(b)
    close(a, rows.astype(float))
    assert a.n == len(rows)
    assert a.sums == [int(s) for s in rows.sum(0)]
    values, _ = rank_one(a.values, a.vectors, np.zeros(rows.shape[1]))
    assert (values == a.values).all()


def plain_whitening(vectors, components=16):
    """id -> (deviation, whitened without sign), and what holds for all rows."""
    good = {i: [float(c) for c in v] for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)}
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in good.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(v) for v in zip(*fit, strict=True)]
    away = {i: [n * c - s for c, s in zip(v, sums, strict=True)] for i, v in x.items()}
    seen = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, basis = np.linalg.eigh(seen.T @ seen / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    white = {i: np.array(v) / n @ basis[:, :k] / np.sqrt(values[:k]) for i, v in away.items()}
    return n, {i: sum(c * c for c in v) for i, v in away.items()}, white, values[:k] / values.sum()


def same_whitening(out, vectors):
    n, deviation, white, explained = plain_whitening(vectors)
    rows = out.collect()
    assert len(rows) == sum(len(white[i]) for i, _ in vectors if i in white)
    signs = {}
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert 0 <= r.identity_error < 1e-9
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 1e-3:
            assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7


def test_whitening_matches_eigh(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(op13_embedding_whitening(spark, SF), vectors)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(90)] + [(100 + i, [1.0, 2.0, 3.0, -1.5, 0.25]) for i in range(200)]
    odd = [(500, None), (501, []), (502, [1.0, None, 2.0, 3.0, 4.0]), (503, [float("nan")] * 5), (504, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (505, [1.0] * 4), (506, [1e300] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    same_whitening(whiten(df), rows)
    twice = whiten(spark.createDataFrame([rows[0], rows[0], *rows[1:], (None, [0.5] * 5)], "vec_id long, embedding array<double>"))
    assert twice.count() == (len(rows) + 2) * 5
    assert twice.filter("vec_id is null").count() == 5
    for few in ([], odd, [rows[0], rows[0]]):
        assert whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    same_whitening(whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")), line)
    far = [(0, [0.0]), (1, [2.0**40])]
    assert {r.deviation for r in whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()} == {None}
