"""Repeated passages, clustering and hard negatives against plain versions, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import elkan, hard_negatives, suffix_trees


def without_repeats(rows):
    """The contract of removal, window by window."""
    words = [(i, suffix_trees.split(t)) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 49):
            seq = tuple(w[k : k + 50])
            if i is not None:
                least[seq] = min(least.get(seq, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n, alphabet):
    """Documents cut from a few sources, with edits, so that repeats begin and end anywhere."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(alphabet)}" for _ in range(rng.randint(40, 260))] for _ in range(4)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(1, 3)):
            src = rng.choice(pool)
            a = rng.randrange(len(src))
            piece = src[a : a + rng.randint(1, 200)]
            if rng.random() < 0.5 and piece:
                piece = list(piece)
                piece[rng.randrange(len(piece))] = f"edit{rng.randrange(9)}"
            text += piece
        rows.append((rng.choice([i, i, i, i // 3, None]), rng.choice([" ", "\n", "\t "]).join(text)))
    return [*rows, *rows[:3], (n, None), (n + 1, ""), (n + 2, " \x0b ")]


@pytest.mark.parametrize("seed, alphabet, most", [(1, 500, 4000), (2, 500, 1), (3, 2, 1), (4, 1, 4000), (5, 30, 8)])
def test_removal_of_repeats(spark, seed, alphabet, most):
    rows = passages(seed, 40, alphabet)
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, prefix string").repartition(3)
    got = suffix_trees.deduplicate(docs, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == without_repeats(rows)


def test_removal_from_odd_documents(odd, no_docs):
    got = suffix_trees.deduplicate(odd)
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert suffix_trees.deduplicate(no_docs).count() == 0


def test_equal_windows_share_their_place():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    alone, inside = suffix_trees.fragments(h[100:250], np.array([150])), suffix_trees.fragments(h, np.array([300]))
    place = lambda f, at: {int(s) + at: (int(p), int(lo + o) + at) for lo, hi, o, p in zip(f["lo"], f["hi"], f["off"], f["prefix"], strict=True) for s in range(lo, hi + 1)}
    one, all_ = place(alone, 100), place(inside, 0)
    assert len(one) == 101 and all(all_[k] == v for k, v in one.items())


def test_nodes_of_a_subtree():
    words = np.array([3, 1, 2, 1, 2, 1, 2, 9, 1, 2, 1], np.uint64)
    starts = np.array([1, 3, 8, 2, 5])
    nodes = suffix_trees.deep_nodes(words, starts, 3)
    assert nodes[0] == nodes[1] == nodes[2] and len({nodes[0], nodes[3], nodes[4]}) == 3


def lloyd(rows, k, rounds):
    kept = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    c, x = np.stack([v for _, v in order[:k]]), np.stack([v for _, v in kept])
    of = lambda c: ((x[:, None] - c) ** 2).sum(2)
    for _ in range(rounds):
        own = of(c).argmin(1)
        c = np.stack([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    d = of(c)
    return sorted(((i, int(a), int(e)) for (i, _), a, e in zip(kept, d.argmin(1), d.min(1), strict=True)), key=str), c


@pytest.mark.parametrize("k, rounds, levels", [(7, 5, 3), (7, 5, 1000), (1, 2, 50), (400, 3, 4), (5, 0, 9), (12, 1, 2)])
def test_clusters(spark, k, rounds, levels):
    rng = np.random.default_rng(k)
    rows = [(int(i), (rng.integers(-levels, levels, 4) / 100).tolist()) for i in range(160)]
    rows += [rows[0], rows[1], (None, [0.0] * 4), (None, [0.0] * 4)]
    bad = [(900, None), (901, [1.0] * 3), (902, [None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("-inf"), 0.0, 0.0, 0.0]), (905, [1e300] * 4), (906, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = elkan.cluster(df, k=k, rounds=rounds, dim=4).collect()
    want, c = lloyd(rows, k, rounds)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()
    assert elkan.cluster(df.where("vec_id >= 900"), dim=4).count() == 0


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (10, 8))
    rows = [(i, (centres[i % 10] + rng.normal(0, 0.02, 8)).tolist()) for i in range(400)]
    got = elkan.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, dim=8)
    assert got.agg(F.sum("measured")).first()[0] < 400 * 10 * 6 / 3


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, old, new = (rng.integers(-9, 9, (n, 3)) for n in (200, 6, 6))
    cluster, _, high, low, _ = elkan.assign(x, old, np.zeros(200, np.int64), np.full(200, np.inf), np.zeros((200, 6)), True)
    high, low = elkan.moved(high, elkan.floats_below(low).astype(float), cluster, old, new)
    true = np.sqrt(((x[:, None] - new) ** 2).sum(2))
    assert (true[np.arange(200), cluster] <= high).all() and (low <= true).all()


def mined(rows, positives=5, negatives=3):
    data = {}
    for i, label, v in rows:
        data[i] = min(data.get(i, (label, v)), (label, v))
    data = {i: (label, np.floor(np.array(v) * 256).astype(int)) for i, (label, v) in data.items()}
    out = []
    for a in (i for i in data if i % 50 == 0):
        la, va = data[a]
        scores = {i: int(v @ va) for i, (_, v) in data.items() if i != a and len(v) == len(va)}
        first = lambda ids, n: sorted(ids, key=lambda i: (-scores[i], i))[:n]  # noqa: B023, E731
        for p in first([i for i in scores if data[i][0] == la], positives):
            inside = [i for i in scores if data[i][0] != la and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            out += [(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(first(inside, negatives))]
    return sorted(out)


@pytest.mark.parametrize("seed, levels, per_block", [(1, 2, 8192), (2, 300, 3), (3, 40, 8192)])
def test_hard_negatives(spark, seed, levels, per_block):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), (rng.integers(-levels, levels, 5 if i % 9 else 6) / 64).tolist()) for i in range(-100, 300)]
    rows += [rows[0], rows[100], (150, 0, [0.5] * 5), (1000, 7, [0.1] * 5)]
    bad = [(50, None, [1.0] * 5), (None, 1, [1.0] * 5), (400, 1, None), (450, 1, [float("nan")] * 5), (500, 1, [None] * 5), (550, 1, [float("inf")] + [0.0] * 4), (600, 1, []), (650, 1, [1e200] * 5)]
    df = spark.createDataFrame([(*r, 3) for r in rows + bad], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, chunk=64, per_block=per_block)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert hard_negatives.mine(df.where("vec_id >= 400 and vec_id < 700"), F.col("vec_id") % 50 == 0).count() == 0


def test_residual_bounds_hold_and_save():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 0.125, (4000, 64)) * 256).astype(np.int64)
    words = hard_negatives.fit_words(x[:2000])
    codes, rest = hard_negatives.encode(x, words)
    a = x[:3]
    est, true = hard_negatives.looked_up(a, codes, words), x @ a.T
    off = rest[:, None] * np.sqrt((a * a).sum(1))
    assert (np.abs(true - est) <= off).all()
    near = hard_negatives.best_within(*((est[:, 0] + s * off[:, 0]).astype(np.int64) for s in (-1, 1)), None, None, 5)
    assert set(np.argsort(-true[:, 0])[:5]) <= set(near) and len(near) < 400
