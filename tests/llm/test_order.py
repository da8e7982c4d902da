"""The language model at order 3 against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from gristmill.llm import kneser_ney, queries


def plain(train):
    """P(w | u, v) by dictionaries, from texts as lists of words and their end."""
    tri, own = Counter(), Counter()
    for ts in train:
        for u, v, w in zip(["<", "<", *ts], ["<", *ts], ts, strict=False):
            if v == "<":
                own[v, w] += 1
            else:
                tri[u, v, w] += 1
    pair = own + Counter((v, w) for _, v, w in tri)
    one = Counter(w for _, w in pair)
    spread = lambda counts: [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    cuts = [kneser_ney.discounts(*spread(c.values())) for c in (one, pair, tri)]

    def level(grams, cut):
        total, follow = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, n in grams.items():
            total[g[:-1]] += n
            follow[g[:-1]][min(n, 3) - 1] += 1

        def p(g, low):
            n, h = grams[g], g[:-1]
            return ((n - cut[min(n, 3) - 1] if n else 0) + math.sumprod(cut, follow[h]) * low) / total[h] if total[h] else low

        return p

    p1, p2, p3 = level(Counter({(w,): n for w, n in one.items()}), cuts[0]), level(pair, cuts[1]), level(tri, cuts[2])
    return lambda u, v, w: p3((u, v, w), p2((v, w), p1((w,), 1 / (len(one) + 1)))) if v != "<" else p2((v, w), p1((w,), 1 / (len(one) + 1)))


def test_trigrams(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    train = [[*t.split(), ">"] for t in texts[:45]]
    p = plain(train)
    for u, v in (("<", "<"), ("<", "a"), ("a", "b"), ("zz", "a"), ("zz", "zz")):
        assert sum(p(u, v, w) for w in {w for ts in train for w in ts} | {"never met"}) == pytest.approx(1)
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts[:45]], "text string"), 100, order=3)
    docs = [*texts, "a b never met a b", None]
    got = {r.doc_id: r for r in kneser_ney.score(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect()}
    count = Counter(itertools.chain(*train))
    for i, t in enumerate(docs):
        ts = [*(t or "").split(), ">"]
        want = sum(math.log10(p(u, v, w)) for u, v, w in zip(["<", "<", *ts], ["<", *ts], ts, strict=False))
        assert got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (count.total() + len(count) + 1)) for w in ts), rel=1e-9)
        assert got[i].n_known == sum(w in count for w in ts)


def test_context_beyond_one_word(spark):
    """Words that only the word before last tells apart, which bigrams score alike."""
    train = spark.createDataFrame([("a x b",), ("c x d",)] * 20, "text string")
    docs = spark.createDataFrame([(1, "a x b"), (2, "a x d")], "doc_id long, text string")
    for order, apart in ((2, False), (3, True), (4, True)):
        one, two = (r.score for r in kneser_ney.score(docs, kneser_ney.fit(train, order=order)).orderBy("doc_id").collect())
        assert (one - two > 0.5) == apart


def test_odd_texts(odd, no_docs):
    assert kneser_ney.score(odd, kneser_ney.fit(no_docs, order=3)).count() == odd.count()
    assert kneser_ney.score(no_docs, kneser_ney.fit(odd, order=4)).count() == 0


def test_registered(spark):
    got = queries.queries()["op9_lm_scoring_trigrams"](spark, "/root/testdata/sf0.001")
    assert got.count() and got.where("score is null or isnan(score) or score > 0").count() == 0
