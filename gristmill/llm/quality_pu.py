r"""A quality classifier learned from positive and unlabelled texts.

Trusted positives are documents labelled good; the unlabelled are all of the web text, whatever its labels. With g the
classifier, l the logistic loss and pi the share of good texts among the unlabelled, it minimises the non-negative
unbiased risk

    max(pi * mean_P l(g), mean_U l(-g) - pi * mean_P g)        as l(g) - l(-g) = -g

which is the larger of two convex functions of the weights, by damped Newton steps on one of them or a mixture. pi is
estimated first: a positives-against-unlabelled classifier orders texts, and pi is the least ratio of unlabelled to
positive mass above any of its scores, taken where enough of both lies above.

Texts are read once: their measurements, some tens of numbers each, are kept in the shared folder, and all else is made
from these. Means, deviations, knots, the unlabelled mass above each score, and the loss, gradient and Hessian of each
step are sums over all rows, made where the rows are; a step is a scan of numbers, and about twenty are taken. Only the
labelled positives are bounded (`most`, first by a hash of their id). Scoring covers all rows and whole texts.
Defined cases: null and empty texts have measurements of 0 and are scored like any; without positives every score is
0.5; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import saved
from gristmill.llm._sampling import first_labelled

SYMBOL = re.compile(r"[#*$%&|<>{}=\\^~@+_]")
ENDS_ODD = re.compile(r"[^\w\s.,;:'\")\]]+(?=\s|$)")
UPPER = re.compile(r"(?<!\S)[^\Wa-z\d_]*[A-ZÀ-ÖØ-Þ]{2,}[^\sa-z]*(?!\S)")
KNOTS = (0.5, 0.8, 0.95, 0.99)
N_MEASURES = 13
#: Chosen among 3e-5 to 1e-2 by held-out accuracy on the two test sizes.
DECAY = 1e-2


def measures(text: str) -> list[float]:
    """Ratios, all in 0..1 but the first two."""
    ws = text.split()
    n = len(ws)
    if not n:
        return [0.0] * N_MEASURES
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lower = text.lower()
    low = lower.split()
    grams = set(zip(low, low[1:], low[2:], strict=False))
    letters = sum(map(len, ws))
    symbols = len(SYMBOL.findall(text))
    return [
        np.log1p(n),
        min(letters / n, 30.0),
        min(symbols / n, 4.0),
        len(ENDS_ODD.findall(text)) / n,
        len(UPPER.findall(text)) / n,
        ws.count("|") / n,
        sum(map(text.count, "0123456789")) / letters,
        len(set(low)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(grams) / max(1, n - 2) if n > 2 else 0.0,
        min(text.count("!") / n, 1.0),
        (text.count(".") + text.count(",")) / n,
        min(len(lines) / n, 1.0),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_MEASURES)


def mass_above(rows: DataFrame, values, edges: np.ndarray) -> np.ndarray:
    """rows (x) -> per column of values(x), and per ascending edge, how many rows of all lie at or above it. A task sends
    one number for each column and gap between edges that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            v = values(matrix(batch.column(0)))
            gap = np.searchsorted(edges, v, "right") + np.arange(v.shape[1]) * (len(edges) + 1)
            found = np.bincount(gap.ravel(), minlength=v.shape[1] * (len(edges) + 1))
            seen = found if seen is None else seen + found
        if seen is not None:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    found = rows.select("x").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    columns = values(np.zeros((1, N_MEASURES))).shape[1]
    counts = np.zeros((columns, len(edges) + 1))
    for r in found:
        counts[divmod(r["at"], len(edges) + 1)] = r["n"]
    return counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        bent = [np.maximum(0, z - k) for k in self.knots]
        return np.concatenate([z, *bent, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def unlabelled_terms(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of a basis, in one array: l(-g), its gradient, and its Hessian row by row."""
    g = np.clip(u @ w, -30, 30)
    q = _sigmoid(g)
    return np.concatenate([[np.logaddexp(0, g).sum()], u.T @ q, ((u * (q * (1 - q))[:, None]).T @ u).ravel()])


def parted(sums: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Means of the loss, its gradient and its Hessian."""
    d = int(np.sqrt(len(sums)))  # 1 + d + d * d
    return sums[0] / n, sums[1 : 1 + d] / n, sums[1 + d :].reshape(d, d) / n


def newton(w: np.ndarray, at, decay: float, steps: int = 25, enough: float = 1e-7) -> np.ndarray:
    """Weights that minimise at(w)[0] + decay / 2 * |w|^2; at gives value, gradient and Hessian. Steps begin at w and are
    halved until the value falls."""

    def whole(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, hessian = at(w)
        return value + decay / 2 * w @ w, gradient + decay * w, hessian + decay * np.eye(len(w))

    now = whole(w)
    for _ in range(steps):
        step = np.linalg.solve(now[2], now[1])
        length = 1.0
        while length > 1e-3:
            tried = w - length * step
            then = whole(tried)
            if then[0] <= now[0] - 1e-4 * length * (now[1] @ step):
                break
            length /= 2
        else:
            return w
        w, fell, now = tried, now[0] - then[0], then
        if fell < enough:
            return w
    return w


def ordering(p: np.ndarray, terms, decay: float = 1e-3) -> np.ndarray:
    """Weights of a classifier of positives against unlabelled; terms(w): the unlabelled's parted sums."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, hessian = terms(w)
        g = np.clip(p @ w, -30, 30)
        q = _sigmoid(g)
        return value + np.logaddexp(0, -g).mean(), gradient + p.T @ (q - 1) / len(p), hessian + (p * (q * (1 - q))[:, None]).T @ p / len(p)

    return newton(np.zeros(p.shape[1]), at, decay)


def least_risk(p: np.ndarray, terms, pi: float, decay: float, halvings: int = 10) -> np.ndarray:
    """Weights of least non-negative risk. Where the unbiased risk's least weights have it below the positives' part, the
    least of the larger one lies where both are equal: at the least of a mixture of the two, whose share is found by
    halving."""
    met: list[tuple[float, float, np.ndarray]] = []

    def mixture(share: float):
        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            value, gradient, hessian = terms(w)
            g = np.clip(p @ w, -30, 30)
            q = _sigmoid(g)
            good, unbiased = pi * np.logaddexp(0, -g).mean(), value - pi * g.mean()
            met.append((max(good, unbiased) + decay / 2 * w @ w, unbiased - good, w))
            good_gradient, good_hessian = pi * p.T @ (q - 1) / len(p), pi * (p * (q * (1 - q))[:, None]).T @ p / len(p)
            unbiased_gradient = gradient - pi * p.mean(0)
            return tuple(share * x + (1 - share) * y for x, y in ((unbiased, good), (unbiased_gradient, good_gradient), (hessian, good_hessian)))

        return at

    low, high, share, w = 0.0, 1.0, 1.0, np.zeros(p.shape[1])
    for _ in range(halvings):
        w = newton(w, mixture(share), decay)
        above = next(m[1] for m in reversed(met) if m[2] is w) if any(m[2] is w for m in met) else 0.0
        if share == 1.0 and above >= 0:
            return w
        low, high = (low, share) if above < 0 else (share, high)
        share = (low + high) / 2
    return min(met, key=lambda m: m[0])[2]


def cuts_of(scores: np.ndarray) -> np.ndarray:
    return np.quantile(scores, np.linspace(0, 0.5, 101))


def least_ratio(scores: np.ndarray, cuts: np.ndarray, above: np.ndarray) -> float:
    """pi from the positives' scores, and the unlabelled share at or above each cut."""
    positive = 1 - np.searchsorted(np.sort(scores), cuts, "left") / len(scores)
    return float(np.clip(np.min(above / np.maximum(positive, 1e-9)), 0.05, 0.99))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """pi from measurements in a common basis, all of them at hand."""
    w = ordering(p, lambda w: parted(unlabelled_terms(u, w), len(u)))
    cuts = cuts_of(p @ w)
    return least_ratio(p @ w, cuts, 1 - np.searchsorted(np.sort(u @ w), cuts, "left") / len(u))


def frame_of(u: np.ndarray) -> Classifier:
    """Means, deviations and knots of measurements at hand, without weights."""
    mean, scale = u.mean(0), u.std(0) + 1e-6
    return Classifier(mean, scale, np.quantile(np.clip((u - mean) / scale, -6, 6), KNOTS, axis=0), np.zeros(1), 0.5)


def learn(p: np.ndarray, u: np.ndarray, decay: float = DECAY, frame: Classifier | None = None) -> Classifier:
    """A classifier from measurements at hand."""
    frame = frame or frame_of(u)
    bp, bu = frame.basis(p), frame.basis(u)
    pi = class_prior(bp, bu)
    w = least_risk(bp, lambda w: parted(unlabelled_terms(bu, w), len(bu)), pi, decay)
    return Classifier(frame.mean, frame.scale, frame.knots, w, pi)


def sums_over(rows: DataFrame, of, width: int) -> np.ndarray:
    """rows (x) -> the sum over all of of(measurements), an array of that width. A task sends one number for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["at", "v"])

    out = np.zeros(width)
    for r in rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def frame_of_all(rows: DataFrame, edges: np.ndarray = np.linspace(-6, 6, 6001)) -> tuple[Classifier, int]:
    """The frame over all rows, its knots to a five-hundredth of a deviation, and the number of rows."""
    x = [F.col("x")[k] for k in range(N_MEASURES)]
    n, *of = rows.agg(F.count("*"), *(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    if not n:
        return Classifier(np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(1), 0.5), 0
    mean, scale = np.array(of[:N_MEASURES]), np.array(of[N_MEASURES:]) + 1e-6
    above = mass_above(rows, lambda v: np.clip((v - mean) / scale, -6, 6), edges)
    knots = np.array([[edges[max(0, (row >= (1 - q) * n).sum() - 1)] for row in above] for q in KNOTS])
    return Classifier(mean, scale, knots, np.zeros(1), 0.5), n


def fit_measured(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8_000, decay: float = DECAY) -> Classifier | None:
    """rows (doc_id, x), kept in files; labels: the training rows only, of which the positives are used."""
    chosen = first_labelled(labels.where(F.col(label) == 1), label, most).select(F.col("doc_id").alias("_id"))
    met = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    p = met.groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x")).orderBy("doc_id")
    frame, n = frame_of_all(rows)
    p = np.array([r["x"] for r in p.select("x").collect()], float).reshape(-1, N_MEASURES)
    if not len(p) or not n:
        return None
    bp = frame.basis(p)
    d = bp.shape[1]
    terms = lambda w: parted(sums_over(rows, lambda x: unlabelled_terms(frame.basis(x), w), 1 + d + d * d), n)
    w = ordering(bp, terms)
    scores = bp @ w
    cuts = cuts_of(scores)
    above = mass_above(rows, lambda x: (frame.basis(x) @ w)[:, None], cuts)[0] / n
    pi = least_ratio(scores, cuts, above)
    return Classifier(frame.mean, frame.scale, frame.knots, least_risk(bp, terms, pi, decay), pi)


def score_measured(rows: DataFrame, model: Classifier | None) -> DataFrame:
    """rows (doc_id, x) -> doc_id, score (the chance of being good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8_000) -> Classifier | None:
    return fit_measured(saved(measured(docs)), labels, label, most)


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    return score_measured(measured(docs), model)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8_000) -> DataFrame:
    """fit and score, with one reading of the texts."""
    rows = saved(measured(docs))
    return score_measured(rows, fit_measured(rows, labels, label, most))
