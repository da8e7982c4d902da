r"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so tokens are labelled first: among words and word beginnings that are far more frequent in
toxic documents, a greedy cover keeps those that explain toxic documents nothing kept so far explains (a text that is
copied a thousand times then contributes one explanation, not all its words). A token is toxic if its document is and
it carries a kept feature. The chain has two states; a token's features (its word, beginnings and ending, hashed) weigh
for the toxic state, transitions are learned with them, by gradient ascent on the exact likelihood of windows.

Scoring runs forward-backward over every whole text; a document's score is a logistic of the logs of the largest and
the summed marginal, fitted on the training documents; spans are the tokens with a marginal of at least 0.5.

Bounds: training uses at most `most` labelled documents and `most_windows` windows; scoring uses all rows.
Defined cases: null and empty texts have no tokens and get the score of a document whose marginals are all 0; without
any toxic document in training every score is the share of toxic labels, 0; repeated rows are scored one by one; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import worker_state
from gristmill.llm._sampling import sampled

DIMS = 1 << 18
WINDOW = 32
WORD = re.compile(r"[^ \t-\r]+")
EDGE = re.compile(r"^\W+|\W+$")


def beginnings(token: str) -> list[str]:
    """The features by which token labels are made: the bare word and its beginnings."""
    w = EDGE.sub("", token.lower())
    return [f"w={w}", *(f"p={w[:k]}" for k in range(3, 7) if len(w) >= k)] if w else []


def features(token: str) -> np.ndarray:
    import zlib

    w = EDGE.sub("", token.lower())
    names = [f"w={w}", *(f"p={w[:k]}" for k in range(3, 7) if len(w) >= k), f"s={w[-3:]}", f"l={min(len(w), 12)}"]
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMS for x in names], np.int64)


def explanations(toxic: list[set[str]], clean: Iterable[set[str]], ratio: float = 25.0, least: int | None = None) -> set[str]:
    """Features kept by the greedy cover of toxic documents. Clean documents pass by once and are not held. least: toxic
    documents that a feature must be in; 4, or 3 where fewer than 100 are known."""
    least = least or (4 if len(toxic) >= 100 else 3)
    t = Counter(x for d in toxic for x in d)
    t = {x: n for x, n in t.items() if n >= least}
    c, n_clean = Counter(), 0
    for d in clean:
        n_clean += 1
        c.update(d & t.keys())
    pure = {x for x, n in t.items() if (n + 0.5) / (len(toxic) + 1) >= ratio * (c[x] + 0.5) / (n_clean + 1)}
    holders: dict[str, list[int]] = {}
    for i, d in enumerate(toxic):
        for x in d & pure:
            holders.setdefault(x, []).append(i)
    kept, explained, left = set(), set(), {x: set(h) for x, h in holders.items()}
    need = max(least, len(toxic) // 200)
    while left:
        best = max(left, key=lambda x: (len(left[x]), len(x), x))
        if len(left[best]) < need:
            break
        kept.add(best)
        new = left[best] - explained
        explained |= new
        # only features that share newly explained documents change
        for x in {x for i in new for x in toxic[i] & pure}:
            if x in left:
                left[x] -= new
                if not left[x]:
                    del left[x]
        left.pop(best, None)
    return kept


@dataclass
class Field:
    """weights: per hashed feature, for the toxic state. moves: log potentials [from][to]. first: of starting toxic."""

    weights: np.ndarray
    moves: np.ndarray
    first: float
    link: tuple[float, float, float]  # of log max, log sum and 1
    _scores: dict = field(default_factory=dict, repr=False)

    def emission(self, token: str) -> float:
        got = self._scores.get(token)
        if got is None:
            got = float(self.weights[features(token)].sum())
            if len(self._scores) < 1_000_000:
                self._scores[token] = got
        return got


def marginals(e: np.ndarray, at: np.ndarray, moves: np.ndarray, first: float) -> np.ndarray:
    """P(toxic) of each token, given emissions of texts one after another. Odds of the two states are passed along all
    texts at once, longest first, so a step is one operation on the texts that are still running."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = at[:-1][order], lengths[order]
    lift = np.exp(np.clip(e, -40, 40))
    (m00, m01), (m10, m11) = np.exp(moves)
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), "left") if steps else []
    fore, back = np.empty(len(e)), np.ones(len(e))
    odds = np.full(len(lengths), np.exp(first))
    for k in range(steps):
        i = starts[: running[k]] + k
        before = odds[: running[k]]
        now = lift[i] * (before if k == 0 else (m01 + m11 * before) / (m00 + m10 * before))
        now = np.clip(now, 1e-30, 1e30)
        fore[i] = odds[: running[k]] = now
    last = starts + lengths - 1
    odds = np.ones(len(lengths))
    for k in range(1, steps):
        # the texts whose token k from the end exists
        n = running[k]
        i = last[:n] - k
        after = lift[i + 1] * odds[:n]
        odds[:n] = np.clip((m10 + m11 * after) / (m00 + m01 * after), 1e-30, 1e30)
        back[i] = odds[:n]
    both = fore * back
    return both / (1 + both)


def likelihood(e: np.ndarray, y: np.ndarray, moves: np.ndarray, first: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Mean log likelihood of windows (n, WINDOW), and its gradients by emission, moves and first."""
    n, t = e.shape
    alpha = np.empty((n, t, 2))
    alpha[:, 0, 0], alpha[:, 0, 1] = 0, first + e[:, 0]
    for k in range(1, t):
        into = np.logaddexp(alpha[:, k - 1, 0, None] + moves[0], alpha[:, k - 1, 1, None] + moves[1])
        alpha[:, k] = into
        alpha[:, k, 1] += e[:, k]
    beta = np.zeros((n, t, 2))
    for k in range(t - 2, -1, -1):
        to = beta[:, k + 1].copy()
        to[:, 1] += e[:, k + 1]
        beta[:, k] = np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    pair = np.empty((2, 2))
    seen = np.empty((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            through = alpha[:, :-1, a] + moves[a, b] + beta[:, 1:, b] + (e[:, 1:] if b else 0) - z[:, None]
            pair[a, b] = np.exp(through).sum()
            seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b)).sum()
    path = (y * e).sum() + y[:, 0].sum() * first + (seen * moves).sum()
    return (path - z.sum()) / n, (y - p) / n, (seen - pair) / n, float((y[:, 0] - p[:, 0]).sum() / n)


def _windows(tokens: list[list[str]], marks: list[np.ndarray], most: int, seed: int) -> tuple[list[list[str]], np.ndarray]:
    """All windows with a marked token, up to half of most, and others at random."""
    with_, without = [], []
    for i, m in enumerate(marks):
        for a in range(0, len(m), WINDOW):
            (with_ if m[a : a + WINDOW].any() else without).append((i, a))
    rng = np.random.default_rng(seed)
    pick = lambda xs, n: [xs[k] for k in sorted(rng.permutation(len(xs))[:n])]
    with_ = pick(with_, most // 2)
    chosen = [*with_, *pick(without, most - len(with_))]
    words = [[*tokens[i][a : a + WINDOW], *[""] * max(0, a + WINDOW - len(tokens[i]))] for i, a in chosen]
    y = np.array([[*marks[i][a : a + WINDOW], *[0] * max(0, a + WINDOW - len(marks[i]))] for i, a in chosen], float)
    return words, y


def train(texts: list[str], labels: list[int], most_windows: int = 12_000, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    one: dict[str, str] = {}  # equal words share one object
    tokens = [[one.setdefault(w, w) for w in WORD.findall(t)] for t in texts]
    of = lambda wanted: ({x for w in set(ws) for x in beginnings(w)} for ws, y in zip(tokens, labels, strict=True) if bool(y) == wanted)
    kept = explanations(list(of(True)), of(False))
    hit = {}
    for ws in tokens:
        for w in ws:
            if w not in hit:
                hit[w] = not kept.isdisjoint(beginnings(w))
    marks = [np.array([bool(y) and hit[w] for w in ws], np.int8) for ws, y in zip(tokens, labels, strict=True)]
    words, y = _windows(tokens, marks, most_windows, seed)
    # without a marked token to learn from, no token is toxic
    model = Field(np.zeros(DIMS), np.array([[0.0, -9.0], [0.0, -9.0]]), -9.0, (1.0, 0.0, 0.0))
    if words and y.any():
        known = {w: features(w) for w in {w for ws in words for w in ws}}
        rows = [[known[w] for w in ws] for ws in words]
        owner = np.repeat(np.arange(y.size), [len(f) for r in rows for f in r])
        ids = np.concatenate([f for r in rows for f in r])
        used, ids = np.unique(ids, return_inverse=True)
        theta = np.zeros(len(used) + 5)
        theta[-1] = -3.0
        theta[len(used) + 1] = -3.0
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            e = np.bincount(owner, theta[ids], y.size).reshape(y.shape)
            _, ge, gm, gf = likelihood(e, y, theta[len(used) : -1].reshape(2, 2), theta[-1])
            g = np.concatenate([np.bincount(ids, ge.ravel()[owner], len(used)), gm.ravel(), [gf]])
            g[: len(used)] -= decay * theta[: len(used)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weights[used] = theta[: len(used)]
        model.moves, model.first = theta[len(used) : -1].reshape(2, 2), float(theta[-1])
    x = evidence(model, tokens)
    return Field(model.weights, model.moves, model.first, logistic(x, np.array(labels, float)))


def evidence(model: Field, tokens: list[list[str]]) -> np.ndarray:
    """Per text: log of the largest and of the summed marginal, and 1."""
    out = np.full((len(tokens), 3), np.log(1e-6))
    out[:, 2] = 1
    some = [i for i, ws in enumerate(tokens) if ws]
    if some:
        at = np.r_[0, np.cumsum([len(tokens[i]) for i in some])]
        p = marginals(np.fromiter((model.emission(w) for i in some for w in tokens[i]), float, at[-1]), at, model.moves, model.first)
        out[some, 0] = np.log(np.maximum.reduceat(p, at[:-1]) + 1e-6)
        out[some, 1] = np.log(np.add.reduceat(p, at[:-1]) + 1e-6)
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Ridge-regularised weights by Newton's method."""
    w = np.zeros(x.shape[1])
    if not len(y) or not y.any():
        return (0.0, 0.0, -20.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5] * x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return tuple(float(a) for a in w)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8_000, **params) -> Field:
    """labels: the training rows only. At most `most` documents come to the driver, copies of a text once, under the
    smallest id and the largest label of any copy."""
    found = sampled(docs, labels, label, most).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).orderBy("doc_id").collect()
    return train([r["text"] or "" for r in found], [int(r["label"]) for r in found], **params)


def tag(docs: DataFrame, model: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, spans (start and end in code points, marginal) of tokens at 0.5 or more."""
    sc = docs.sparkSession.sparkContext
    used = np.flatnonzero(model.weights)
    shared = sc.broadcast((used, model.weights[used], model.moves, model.first, model.link))  # at most DIMS numbers
    name = uuid.uuid4().hex
    schema = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if state.get("crf", (None,))[0] != name:
            ids, values, moves, first, link = shared.value
            weights = np.zeros(DIMS)
            weights[ids] = values
            state["crf"] = (name, Field(weights, moves, first, link))
        crf = state["crf"][1]
        for batch in batches:
            for a, b in _portions(batch.column(1)):
                texts = [t or "" for t in batch.column(1)[a:b].to_pylist()]
                yield _tagged(batch.column(0)[a:b], texts, crf)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _portions(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text at most, and one row at least."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64, len(texts) + 1, texts.offset * (4 if pa.types.is_string(texts.type) else 8)))
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def _tagged(ids: pa.Array, texts: list[str], crf: Field) -> pa.RecordBatch:
    tokens = [WORD.findall(t) for t in texts]
    at = np.r_[0, np.cumsum([len(ws) for ws in tokens])].astype(np.int64)
    get = crf.emission
    e = np.fromiter((get(w) for ws in tokens for w in ws), float, at[-1])
    some = np.flatnonzero(np.diff(at))
    p = marginals(e, np.r_[at[some], at[-1]], crf.moves, crf.first) if len(some) else np.empty(0)
    x = np.full((len(texts), 3), np.log(1e-6))
    x[:, 2] = 1
    if len(some):
        x[some, 0] = np.log(np.maximum.reduceat(p, at[some]) + 1e-6)
        x[some, 1] = np.log(np.add.reduceat(p, at[some]) + 1e-6)
    score = 1 / (1 + np.exp(-np.clip(x @ np.array(crf.link), -30, 30)))
    flagged = np.flatnonzero(p >= 0.5)
    spans: list[list[dict]] = [[] for _ in texts]
    owner = np.searchsorted(at, flagged, "right") - 1
    for i in np.unique(owner):
        wanted = dict(zip((flagged[owner == i] - at[i]).tolist(), p[flagged[owner == i]].tolist(), strict=True))
        spans[i] = [{"start": m.start(), "end": m.end(), "p": wanted[k]} for k, m in enumerate(WORD.finditer(texts[i])) if k in wanted]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])
