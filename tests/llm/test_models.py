"""Classifiers, the language model, decontamination and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingspark.llm import decontam, lm, quality, toxicity
from listingspark.llm import texthash as H
from listingspark.llm.decontam import align, decontaminate, find_leaks
from listingspark.llm.neardup import drop_near_duplicates
from tests.llm.test_neardup import words_of

SF = "/root/testdata/sf0.01"


def held(i, m):
    return zlib.crc32(str(i).encode()) % m == 0


def accuracy(spark, name, label):
    from listingspark.llm.queries import queries

    got = {r.doc_id: r for r in queries()[name](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == held(i, 5) for i, r in got.items())
    rows = [(r[label], got[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    return np.mean([y == r.predicted for y, r in rows if r.held_out])


def test_quality_held_out(spark):
    assert accuracy(spark, "op1_quality", "quality") > 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, "op2_toxicity", "toxic") > 0.93


def test_trees_learn_and_score_in_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    t = quality.grow(x[:500], y[:500])
    assert ((t.score(x[500:]) > 0.5) == y[500:]).mean() > 0.9
    assert np.allclose(quality.grow(x[:0], y[:0]).score(x[:3]), 0.5)


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", " ", "a", "A! é", "w " * 50000]))
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all() and not x[:2].any()


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (2, None, 1), (None, "c", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (quality.score_quality, toxicity.score_toxicity):
            got = f(docs, labels).collect()
            assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
            assert f(docs.limit(0), labels).count() == 0


def lexicon(context=None):
    return toxicity.Lexicon(["idiot", "lowei", "scum"], [False, True, False], [5.0, 5.0, 5.0], -2.0, context or {})


@pytest.mark.parametrize(
    ("word", "term"),
    [("idiot", 0), ("Idiot!", 0), ("idoit", None), ("idi0t", 0), ("idiots", 0), ("iidiot", 0), ("idot", None), ("idioz", 0), ("loweischaft", 1), ("lowe", None), ("scum", 2), ("scam", None), ("scums", None), ("idea", None)],
)
def test_automaton_finds_misspellings(word, term):
    hit = lexicon().find(word)
    assert (hit[0] if hit else None) == term


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    lex = toxicity.Lexicon(["abcab", "bcaabc", "cabba"], [False] * 3, [1.0] * 3, 0.0, {})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 8)))
        best = min((distance(t, w), k) for k, t in enumerate(lex.terms))
        hit = lex.look_up(w)
        assert (hit[1] if hit else None) == (best[0] if best[0] <= 1 else None)
        if hit:
            assert lex.likely(w)


@pytest.mark.parametrize(
    ("word", "term"),
    [("ldiots", 0), ("idoots", 0), ("idiotically", 0), ("iidiotic", 0), ("idea", None), ("degenerate", 1), ("dgeenerate", 1), ("degenrat", 1), ("degenerrrrate", None), ("basatrd", 2), ("batsrad", None)],
)
def test_misspelled_stems_swaps_and_long_terms(word, term):
    lex = toxicity.Lexicon(["idiot", "degenerate", "bastard"], [True, False, False], [5.0] * 3, -2.0, {})
    hit = lex.find(word)
    assert (hit[0] if hit else None) == term


def swap_distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_long_terms_and_stems_equal_brute_force():
    rng = random.Random(8)
    terms, stems = ["abcabca", "bcaabcab", "cabbacabc", "abacb", "bbcaccaa"], [False, False, False, True, True]
    lex = toxicity.Lexicon(terms, stems, [1.0] * 5, 0.0, {})
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 12)))
        if rng.random() < 0.7:
            w = list(rng.choice(terms) + "ca"[: rng.randrange(3)])
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abc")
            w = "".join(w)
        found = []
        for t, s in zip(terms, stems, strict=True):
            far = swap_distance if len(t) >= 7 else distance
            edits = min(far(t, w[:k]) for k in range(len(w) + 1)) if s else far(t, w)
            if edits <= (1 if len(t) < 8 else 2):
                found.append(edits)
        hit = lex.look_up(w)
        assert (hit[1] if hit else None) == (min(found) if found else None)
        if hit:
            assert lex.likely(w)


def test_quotation_lowers_the_score():
    plain = toxicity._score(lexicon({"quoted": -3.0}), "you are an idiot and more")[0]
    quoted = toxicity._score(lexicon({"quoted": -3.0}), 'he wrote "what an idiot" and more')[0]
    assert quoted < 0.7 < plain


def brute_lm(rows):
    train, n = Counter(), 0
    for i, t in rows:
        if i is not None and not held(i, 10):
            train.update([*words_of(t), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        tokens = [*words_of(t), None]
        out[i] = (len(tokens), sum(train[w] > 0 for w in tokens), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
    return out


@pytest.mark.parametrize("head", [1 << 19, 5])
def test_language_model_base_matches_brute_force(spark, monkeypatch, head):
    rng = random.Random(3)
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sat", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "only-here unseen"), (203, "the " * 4000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in lm.score_language(docs).collect()}
    for i, want in brute_lm(rows).items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and math.isclose(r.base_score, want[3], rel_tol=1e-9)
        assert r.score < 0 and r.held_out == held(i, 10)
    assert lm.score_language(docs.limit(0)).count() == 0


def test_language_model_beats_the_base_on_patterns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{a} {a}x" for a in rng.choices("abcdefghij", k=40))) for i in range(1500)]
    got = [r for r in lm.score_language(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_language_model_predicts_rare_words(spark):
    """Words beyond the frequent classes are predicted from their contexts as well."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (rng.randrange(2500) for _ in range(60)))) for i in range(1500)]
    got = [r for r in lm.score_language(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.06 * sum(r.n_tokens for r in got)


def trained(spark, rows):
    """A model of ``rows`` with its words, and the units of some texts."""
    vocabulary = Counter(w for t in rows for w in [*words_of(t), None])
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    hashes, forms, edges = zip(*[(h, f, np.diff(e)) for _, h, f, e in lm._texts(batch)], strict=True)
    h, f, edge = np.concatenate(hashes), np.concatenate(forms), np.concatenate([[0], np.cumsum(np.concatenate(edges))])
    keys, first, counts = np.unique(h, return_index=True, return_counts=True)
    assert sorted(counts) == sorted(vocabulary.values())
    table = spark.createDataFrame([(int(k), int(c), int(x)) for k, c, x in zip(keys.view(np.int64), counts, f[first], strict=True)], "h long, c long, form int")
    words, mass = lm.known_words(table)
    units = words.units(words.table.get(h), f)
    texts = [units[a:b].astype("<u2").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    train = spark.createDataFrame([(k % lm.PARTS, x) for k, x in enumerate(texts)], "part int, units binary")
    return lm.train_model(train, words, mass), words, mass, units.astype(np.int64), edge, dict(zip(keys.tolist(), counts.tolist(), strict=True)), h, f


def some_texts(seed, n=200):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice(('un', 're', 'o'))}{rng.randrange(40)}" if rng.random() < 0.8 else f"x{rng.randrange(9999)}" for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_model_is_a_distribution(spark):
    """For a context the shares of all units add up to one, and so do those of a form's words."""
    model, words, mass, units, edge, counts, h, f = trained(spark, some_texts(0))
    real = np.flatnonzero(mass > 0)
    one, two = lm._contexts(units, edge)
    for k in (0, 1, 2, 50, 333):
        logs = lm.unit_logs(model, real, np.full(len(real), one[k]), np.full(len(real), two[k]))
        assert math.isclose((10**logs).sum(), 1, rel_tol=1e-4)
    form_of = dict(zip(h.tolist(), f.tolist(), strict=True))
    own = {int(x) for x, u in zip(h, units, strict=True) if u >= lm.FORMS}
    for form in {form_of[x] for x in counts if x not in own}:
        share = sum(counts[x] + 0.1 for x in counts if x not in own and form_of[x] == form)
        assert math.isclose(share + 0.1, 10 ** words.form_log[form], rel_tol=1e-9)


def test_unit_logs_and_gradient_match_plain_loops(spark):
    """The vectorised score and gradient against loops over single tokens."""
    model, _, _, units, edge, *_ = trained(spark, some_texts(1, 60))
    s = model.shape
    one, two = lm._contexts(units, edge)
    got = lm.unit_logs(model, units, one, two)
    gradient = np.zeros((sum(lm.ROWS), lm.CLASSES))
    starts = set(edge[:-1].tolist())
    for k, u in enumerate(units.tolist()):
        before = lm.UNITS if k in starts else int(units[k - 1])
        skip = lm.UNITS if k in starts or k - 1 in starts else int(units[k - 2])
        assert (before, skip) == (one[k], two[k])
        rows = [int(r[0]) for r in lm._feature_rows(np.array([before]), np.array([skip]))]
        logits = [float(lm._bias(s)[c]) + sum(float(model.weights[r, c]) for r in rows) for c in range(lm.CLASSES)]
        total = sum(map(math.exp, logits))
        log = math.log(math.exp(logits[s.cls[u]]) / total)
        for c in range(lm.CLASSES):
            for r in rows:
                gradient[r, c] += math.exp(logits[c]) / total - (c == s.cls[u])
        for level in range(3):
            node, branch = int(s.node[u, level]), int(s.branch[u, level])
            if node >= 0:
                r = int(lm._node_rows(np.array([s.near[before]]), np.array([node]))[0])
                log += math.log((model.node_counts[r, branch] + lm.NODE_PRIOR * s.prior[node, branch]) / (sum(model.node_counts[r, : s.last[node] + 1]) + lm.NODE_PRIOR))
        assert math.isclose(got[k], log / math.log(10), rel_tol=1e-4, abs_tol=1e-5)
    texts = [units[a:b].astype("<u2").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    shared = spark.sparkContext.broadcast((s, model.weights))
    sums = lm._gradient(shared)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["units"])]))
    assert np.allclose(sums.reshape(gradient.shape) / lm.SCALE, gradient, atol=len(units) / lm.SCALE)


def test_rounds_lower_the_loss(spark):
    """Training ends nearer to the texts than it starts, and every part of them is read once."""
    assert [x for a, b in lm.ROUNDS for x in range(a, b)] == list(range(lm.PARTS))
    rng = random.Random(9)
    texts = [" ".join(f"{rng.choice('ab')}{k}{rng.randrange(30)} the" for _ in range(40)) for k in ("x", "y") for _ in range(300)]
    rng.shuffle(texts)
    model, _, _, units, edge, *_ = trained(spark, texts)
    one, two = lm._contexts(units, edge)
    after = lm.unit_logs(model, units, one, two).mean()
    model.weights = np.zeros_like(model.weights)
    assert after > lm.unit_logs(model, units, one, two).mean() + 0.05


def test_scores_do_not_depend_on_partitions(spark):
    rows = list(enumerate(some_texts(4, 400))) + [(7, "again a row"), (7, "again a row"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 9), round(r.base_score, 9), r.held_out)
    one, two = (sorted(map(key, lm.score_language(docs.repartition(n, F.rand(n))).collect())) for n in (2, 7))
    assert one == two
    assert all(h for i, *_, h in one if i == "None") and sum(i == "7" for i, *_ in one) == 3


def test_head_count_is_exact(spark):
    rng = random.Random(5)
    counts = [rng.choice([1, 2, 3, 900, 1500, 3000, 70_000, 70_001, 5_000_000]) + rng.randrange(3) for _ in range(3000)]
    vocabulary = spark.createDataFrame([(c,) for c in counts], "c long")
    for most in (0, 1, 5, 700, 1500, 2999, 3000, 9999):
        least = lm.head_count(vocabulary, most)
        assert sum(c >= least for c in counts) <= most
        below = [c for c in counts if c < least]
        assert not below or sum(c >= max(below) for c in counts) > most


def test_packed_sums_come_back():
    for x in (np.array([0, -1, 5, 1 << 40, -(1 << 50)]), np.zeros(0, np.int64), np.arange(-500, 500)):
        assert (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x))) == len(x)


def test_table_finds_its_keys():
    table = lm.Table(np.arange(1, 6, dtype=np.uint64) * np.uint64(1 << 60), np.arange(5))
    assert table.get(np.array([1, 3, 7], dtype=np.uint64) * np.uint64(1 << 60)).tolist() == [0, 2, -1]


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert align(a, b)[0] == brute_align(a, b)


def brute_leaks(docs, items, least):
    words = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if w]
    out = {}
    for d, t in docs:
        for i, x in items:
            a, b = words(x), words(t)
            if a and b:
                score = brute_align(a, b) / (2 * len(a))
                if score >= least:
                    out[d, i] = score
    return out


@pytest.mark.parametrize("block", [20_000, 4])
def test_leaks_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of", "and"] * 200
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(text(rng.randrange(8, 50)))) for k in range(12)] + [(50, "zq zr"), (51, None), (52, "")]
    docs = []
    for k in range(60):
        body = text(rng.randrange(0, 120))
        if k % 3 == 0:  # a copy, edited by word replacements, drops and case
            w = items[k % 12][1].split()
            edited = [x.upper() if rng.random() < 0.2 else x for x in w if rng.random() > 0.05]
            edited = [rng.choice(vocabulary) if rng.random() < 0.15 else x for x in edited]
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited
        docs.append((k, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "x zq zr y")]
    a = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_leaks(a.drop("item_id"), b).collect()}
    want = brute_leaks(docs, items, 0.5)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    kept = {r.doc_id for r in decontaminate(a, b).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert find_leaks(a.limit(0).drop("item_id"), b).count() == 0 and find_leaks(a.drop("item_id"), b.limit(0)).count() == 0


@pytest.mark.parametrize("edit", ["third", "fourth", "inserted", "dropped", "mixed"])
def test_leaks_reach_every_alignment_of_a_half(spark, edit):
    """Copies without three words in a row: all that full alignment scores a half are found."""
    rng = random.Random(edit)
    vocabulary = [f"v{i}" for i in range(2000)] + ["the", "of", "and", "to", "in"] * 300
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 45)))) for k in range(40)]
    docs = []
    for k, text in items:
        w = text.split()
        if edit == "third":
            w = [f"n{rng.randrange(10**6)}" if j % 3 == 1 else x for j, x in enumerate(w)]
        elif edit == "fourth":
            w = [f"n{rng.randrange(10**6)}" if j % 4 == 3 else x for j, x in enumerate(w)]
        elif edit == "inserted":
            w = [y for x in w for y in (x, "new")]
        elif edit == "dropped":
            w = [x for j, x in enumerate(w) if j % 3]
        else:
            w = [y for x in w for y in ((x,), (), ("z",), (x, "q"))[rng.choices(range(4), (7, 1, 1, 1))[0]]]
        docs.append((k, " ".join(rng.choices(vocabulary, k=20) + w + rng.choices(vocabulary, k=20))))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items, 0.5)
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in find_leaks(a, b).collect()} == {k: round(v, 6) for k, v in want.items()}
    assert sum((k, k) in want for k, _ in items) > 10


def test_leaks_of_odd_tables(spark):
    """Null ids, repeated rows and a very long text."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, "x " * 50_000 + item), (None, item), (1, item), (2, "x " * 5000)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(None, item), (7, item), (7, item)], "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.score) for r in find_leaks(a, b).collect())))
    assert got == sorted(str((d, i, 1.0)) for d in (1, 1, None) for i in (None, 7))
    assert [r.doc_id for r in decontaminate(a, b).collect()] == [2]


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (1, "A b c d e f g", "y"), (None, "a b c d e f g", "z"), (4, None, "n"), (5, "other words here", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, None, 4, 5], key=str)


def plain_near_dedup(before):
    from tests.llm.test_neardup import shingle_set

    sets = {i: shingle_set(r.text, 5) for i, r in before.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def plain_toxicity(lex, text):
    """The score by a look-up of every word against every term, without trie, forms or batches."""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    hits = {}
    for i, w in enumerate(words):
        forms = [(toxicity.bare(w), 0)]
        if not forms[0][0].isalpha():
            forms.append((forms[0][0].translate(toxicity._LOOKALIKE), 1))
        for form, more in forms:
            if len(forms[0][0]) < 3 or (more and (form == forms[0][0] or not form.isalpha())):
                continue
            found = []
            for k, (t, stem) in enumerate(zip(lex.terms, lex.stems, strict=True)):
                far = swap_distance if len(t) >= toxicity.SWAPS else distance
                if not stem and abs(len(t) - len(form)) > 2:
                    continue
                edits = min(far(t, form[:n]) for n in range(min(len(form), len(t) + 2) + 1)) if stem else far(t, form)
                if edits <= min(0 if len(form) < 5 else 9, toxicity.allowed(len(t))):
                    found.append((edits, k))
            if found and (not more or min(found)[0] == 0):
                hits[i] = (more + min(found)[0], {k for e, k in found if e == min(found)[0]})
                break
    return words, hits


def test_toxicity_scores_match_a_plain_version(spark):
    """Finds and scores of whole texts by the learned lexicon against plain loops."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.train_lexicon(docs, labels, toxicity.Scratch(spark, "t"), "doc_id", "text", "toxic", toxicity.id_remainder("id", 5) == 0, toxicity.SAMPLE)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id not in toxic, len(r.text or "")))
    some = [r for r in rows if len(r.text or "") < 3000][:40] + [r for r in rows if r.doc_id not in toxic and len(r.text or "") < 3000][:40]
    for r in some:
        words, want = plain_toxicity(lex, r.text)
        got = {row: (w, hits) for row, w, hits in lex.spotted(pa.array([r.text], pa.string()))}.get(0, (words, {}))
        assert got[0] == words and set(got[1]) == set(want)
        for i, (term, edits) in got[1].items():
            assert edits == want[i][0] and term in want[i][1]
        score = toxicity._score(lex, r.text)[0]
        if not want:
            assert math.isclose(score, 1 / (1 + math.exp(-lex.none)))
            continue
        best, n = {}, 0
        for i, (term, edits) in got[1].items():
            w = lex.edited.get((term, edits), 0.75 * lex.weights[term]) if edits else lex.weights[term]
            n += w > 1
            around = sum(lex.context.get(f, 0) for f in toxicity.features(words, i))
            best[term] = max(best.get(term, 0), w + min(1, max(-3, around)))
        total = sum(w * toxicity.FADE**k for k, w in enumerate(sorted(best.values(), reverse=True)))
        x = lex.scale[0] + lex.scale[1] * total + lex.scale[2] * math.log(len(words)) + lex.scale[3] * math.log1p(n)
        assert math.isclose(score, 1 / (1 + math.exp(-x)), rel_tol=1e-6)


def test_equal_texts_with_both_labels_and_long_texts(spark):
    """Reruns agree; a text of very many words and one word of very many letters are read whole."""
    rows = [(i, f"word{i % 50} filler text {'slurry' if i % 4 == 0 else 'pleasant'} more{i % 37}") for i in range(400)]
    rows += [(1000 + k, "same text slurry here") for k in range(6)] + [(2000, "calm " * 60_000 + "slurry"), (2001, "x" * 200_000), (2002, "calm " * 60_000)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000 + k, k % 2) for k in range(6)], "doc_id long, toxic int")
    one, two = (sorted((r.doc_id, round(r.score, 9), r.n_finds) for r in toxicity.score_toxicity(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert one == two
    found = {i: n for i, _, n in one}
    assert (found[2000], found[2001], found[2002]) == (1, 0, 0)


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage's output is what a plain version of it makes of its own input."""
    import zlib as z

    import duckdb

    from listingspark.llm.queries import OP6_SQL, vocabulary_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: H.words(pa.array([t], pa.string()), letters=True)[0]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    source = f"{SF}/documents.parquet"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = {r.doc_id: r for r in docs.collect()}
        rows = after.collect()
        if k < 4:
            assert after.columns == columns and all(tuple(r) == tuple(before[r.doc_id]) for r in rows)
        kept = {r.doc_id for r in rows}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r.doc_id, 5)}
            assert np.mean([(i not in kept) == bool(y) for i, y in labels.items()]) > 0.95
            assert all(i in kept for i, y in labels.items() if not y)
        elif name == "near_dedup":
            assert kept == plain_near_dedup(before) and len(rows) == len(kept)
        elif name == "decontamination":
            score = lambda t, x: align(words(x), words(t))[0] / (2 * len(words(x)))
            for i in set(before) - kept:
                assert max(score(before[i].text, x) for _, x in items) >= 0.5
            for i in sorted(kept)[:25]:
                assert len(before[i].text or "") > 9000 or max(score(before[i].text, x) for _, x in items) < 0.5
        elif name == "mixing":
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{source}'")
            want = {r[0]: r[4] // r[1] for r in con.execute(f"select doc_id, size, source_size, target, taken from ({OP6_SQL})").fetchall() if r[1]}
            assert Counter(r.doc_id for r in rows if words(r.text).size) == Counter({i: n for i, n in want.items() if n and words(before[i].text).size})
        elif name == "token_output":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(vocabulary_path())
            start, want = 0, []
            for r in sorted(docs.collect(), key=lambda r: r.doc_id):
                ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
                want.append((r.doc_id, start, len(ids), z.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
        docs, source = after, f"{tmp_path / name}/*.parquet"


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, a long text and empty tables go through all stages."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some plain words " * 5, "en", None, 3), (3, "some plain words " * 5, "en", None, 3), (None, "no id here at all", "en", "b", 1), (4, "long words " * 30_000, "en", "b", 9)]
    for name, rows in (("odd", odd), ("empty", [])):
        for table, data, schema in (("documents", rows, ddl), ("labels", [(1, 1, 1), (3, None, 0)][: len(rows)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "nothing like the others is in here"), (None, None)][: len(rows)], "item_id long, text string")):
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == bool(rows)
        assert all(r.n_tokens >= 1 for r in got)


def test_word_hash_letters():
    h, at, a, b = H.words(pa.array(["It's 5, é-x", "--"]), letters=True)
    assert np.diff(at).tolist() == [5, 0]
