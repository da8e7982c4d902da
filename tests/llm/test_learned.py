"""Held-out accuracy of the learned operators, and pieces of them against plain versions."""

import itertools

import numpy as np
import pytest

from gristmill.llm import quality_pu, queries, toxicity
from gristmill.llm._common import table

SMALL = "/root/testdata/sf0.1"


def auc(score, y):
    _, place, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (y == 0).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.9), ("op6_quality_classifier", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    labels = table(spark, SMALL, "labels").groupBy("doc_id").max(label).toPandas().set_index("doc_id")[f"max({label})"]
    got = queries.queries()[name](spark, SMALL).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held[f"max({label})"].to_numpy()) > least
    assert (held.predicted == held[f"max({label})"]).mean() > 0.95


def paths(e, moves, first):
    for y in itertools.product((0, 1), repeat=len(e)):
        yield y, first * y[0] + sum(a * b for a, b in zip(e, y, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(y))


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    moves, first = rng.normal(size=(2, 2)), -0.7
    texts = [rng.normal(size=n) for n in (1, 5, 3, 7)]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = toxicity.marginals(np.concatenate(texts), at, moves, first)
    for a, e in zip(at, texts, strict=False):
        w = {y: np.exp(s) for y, s in paths(e, moves, first)}
        want = [sum(v for y, v in w.items() if y[k]) / sum(w.values()) for k in range(len(e))]
        assert np.allclose(got[a : a + len(e)], want)


def test_likelihood_gradient():
    rng = np.random.default_rng(3)
    e, y, moves = rng.normal(size=(3, 4)), rng.integers(0, 2, (3, 4)).astype(float), rng.normal(size=(2, 2))
    value, ge, gm, gf = toxicity.likelihood(e, y, moves, -0.4)
    want = np.mean([dict(paths(a, moves, -0.4))[tuple(map(int, b))] - np.log(sum(np.exp(s) for _, s in paths(a, moves, -0.4))) for a, b in zip(e, y, strict=True)])
    assert value == pytest.approx(want)
    h = 1e-6
    bumped = moves.copy()
    bumped[1, 0] += h
    assert (toxicity.likelihood(e, y, bumped, -0.4)[0] - value) / h == pytest.approx(gm[1, 0], abs=1e-4)
    more = e.copy()
    more[2, 1] += h
    assert (toxicity.likelihood(more, y, moves, -0.4)[0] - value) / h == pytest.approx(ge[2, 1], abs=1e-4)
    assert (toxicity.likelihood(e, y, moves, -0.4 + h)[0] - value) / h == pytest.approx(gf, abs=1e-4)


def test_copies_explain_little():
    copied = [{f"w=x{i}" for i in range(30)} | {"w=moron"} for _ in range(50)]
    toxic = copied + [{f"w=y{k}", "w=moron"} for k in range(20)] + [{f"w=z{k}", "w=scum"} for k in range(20)]
    assert toxicity.explanations(toxic, [{f"w=y{k % 20}", f"w=z{k % 20}"} for k in range(400)]) == {"w=moron", "w=scum"}


def test_spans(spark):
    texts = ["the day is fine and long", "you are a moron , go", "what a moron is that", "nice words here", "a moron and a clown", "clown of the town"] * 6
    labels = [0, 1, 1, 0, 1, 1] * 6
    model = toxicity.train([f"{t} {i}" for i, t in enumerate(texts + texts[::3] * 8)], labels + [0] * 96)
    df = spark.createDataFrame([(1, "the \U0001f600fine moron is"), (2, "fine day")], "doc_id long, text string")
    one, two = toxicity.tag(df, model).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in one.spans] == [(10, 15)] and two.spans == [] and one.score > two.score


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 3)), rng.normal(3, 1, (1000, 3))
    model = quality_pu.learn(good[:1500], np.concatenate([good[1500:], bad[:500]]))
    assert abs(model.prior - 0.75) < 0.1  # the least ratio over many cuts is a little low
    assert (model.score(good[1500:]) > 0.5).mean() > 0.95 and (model.score(bad[500:]) < 0.5).mean() > 0.95


def test_frame_and_masses_of_all_rows(spark):
    """Counted over partitions, against the same measurements in one array."""
    rng = np.random.default_rng(5)
    x = rng.gamma(2, 1, (700, quality_pu.N_MEASURES))
    x[:, 3] = 0
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "doc_id long, x array<double>").repartition(5)
    got, n = quality_pu.frame_of_all(rows)
    want = quality_pu.frame_of(x)
    assert n == 700 and np.allclose(got.mean, want.mean) and np.allclose(got.scale, want.scale)
    assert np.abs(got.knots - want.knots).max() < 0.1
    edges = np.array([0.5, 1.0, 1.0, 2.5])
    above = quality_pu.mass_above(rows, lambda v: v[:, :2], edges)
    assert above.tolist() == [[float((x[:, k] >= e).sum()) for e in edges] for k in (0, 1)]


def test_repeated_rows_keep_their_share(spark):
    """One row is a third of all: it neither fills the sample of unlabelled rows nor leaves it."""
    good, bad = "the small house stands by the long river and the day is fine . " * 3, "BUY!!! $$$ ### |||| CLICK &&& NOW!!! " * 5
    rows = [(i, good + str(i)) for i in range(60)] + [(100 + i, bad + str(i)) for i in range(60)] + [(7_777, bad)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    got = quality_pu.classify(docs, labels, most=20).toPandas()
    assert len(got) == 180 and got[got.doc_id < 60].score.min() > got[got.doc_id >= 100].score.max()


def test_classifier_against_plain_version(spark):
    """Every row counts, whatever the partitions: the same model from sums over partitions and from one array."""
    rng = np.random.default_rng(8)
    x = rng.gamma(2, 1, (600, quality_pu.N_MEASURES))
    x[:300] *= 0.4
    rows = [(i, list(map(float, r))) for i, r in enumerate(x)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120)] + [(i, 0) for i in range(400, 420)], "doc_id long, quality int")
    got = [quality_pu.fit_measured(spark.createDataFrame(rows, "doc_id long, x array<double>").repartition(k), labels) for k in (1, 6)]
    frame, _ = quality_pu.frame_of_all(spark.createDataFrame(rows, "doc_id long, x array<double>"))
    want = quality_pu.learn(x[:120], x, frame=frame)
    for model in got:
        assert abs(model.prior - want.prior) < 0.02
        assert np.abs(model.score(x) - want.score(x)).max() < 0.02
    assert np.abs(got[0].score(x) - got[1].score(x)).max() < 1e-6
    assert (want.score(x[120:300]) > 0.5).mean() > 0.8 and (want.score(x[300:]) < 0.5).mean() > 0.8


def test_risk_by_differences():
    """Newton's gradient and Hessian are those of the risk, and no direction from its result lowers it."""
    rng = np.random.default_rng(2)
    for centre, clamped in ((1.0, True), (0.1, False)):
        p, u = np.c_[rng.normal(centre, 1, (80, 2)), np.ones(80)], np.c_[rng.normal(0, 1.5, (200, 2)), np.ones(200)]
        w = quality_pu.least_risk(p, lambda w, u=u: quality_pu.parted(quality_pu.unlabelled_terms(u, w), len(u)), 0.4, 1e-3)
        rest = lambda w, p=p, u=u: np.logaddexp(0, u @ w).mean() - 0.4 * np.logaddexp(0, p @ w).mean()
        risk = lambda w, p=p: 0.4 * np.logaddexp(0, -(p @ w)).mean() + max(0.0, rest(w)) + 5e-4 * w @ w  # noqa: B023, E731
        assert (abs(rest(w)) < 0.01) == clamped
        assert all(risk(w + size * rng.normal(0, 1, 3)) >= risk(w) - 1e-4 for size in (0.02, 0.3) for _ in range(200))


def test_document_score_by_hand(spark):
    """A document's toxicity is the logistic link of its largest marginal and of the sum of all."""
    texts = ["the day is fine and long", "you are a moron , go", "what a moron is that", "nice words here"] * 8
    model = toxicity.train([f"{t} {i}" for i, t in enumerate(texts)], [0, 1, 1, 0] * 8)
    rows = [(1, "a moron in the day"), (2, ""), (3, None), (4, "fine words")]
    got = {r.doc_id: r.score for r in toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        ws = toxicity.WORD.findall(text or "")
        p = toxicity.marginals(np.array([model.emission(w) for w in ws]), np.array([0, len(ws)]), model.moves, model.first) if ws else np.empty(0)
        most, total = (np.log(p.max() + 1e-6), np.log(p.sum() + 1e-6)) if ws else (np.log(1e-6), np.log(1e-6))
        a, b, c = model.link
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(a * most + b * total + c, -30, 30)))) < 1e-9
