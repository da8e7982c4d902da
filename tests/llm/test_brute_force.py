"""Operators against plain versions on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from support import TINY, rows_of
from pyspark.sql import functions as F

from gristmill.llm import ann, kneser_ney, mixing, ngram_join, packing, pii, queries
from gristmill.llm._common import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, TINY, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, TINY).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_ann_recall(spark):
    rows = table(spark, TINY, "embeddings").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = queries.op1_ann(spark, TINY).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        hits += len(set(best) & set(mine.vec_id))
        total += 5
    assert hits / total >= 0.9


def test_codes_are_unbiased():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    turn = ann.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, f = ann.encode(x, turn)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    q /= np.linalg.norm(q)
    estimate = signs @ (turn @ q) / 8 / f
    true = x @ q / np.linalg.norm(x, axis=1)
    assert abs((estimate - true).mean()) < 0.005
    bound = 3.0 * np.sqrt((1 - f * f) / (f * f)) / math.sqrt(63)
    assert (np.abs(estimate - true) <= bound).mean() > 0.99


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    got = queries.op2_packing(spark, TINY).toPandas()
    for doc_id, rows in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert list(rows.piece) == list(range(len(rows))) and rows.length.sum() == len(ids)
        assert len(rows) == 1 or (rows.length[1:] == 2048).all()
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(got.doc_id) == set(texts)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_word_by_word_ids():
    enc = packing.encoder(packing.default_vocabulary())
    odd = ["a  b", "  a b ", "x \n y", "tab\t z", "it 's we've don't", "<|endoftext|> a<|endoftext|> b", "é ü 你好 \U0001f600 ​ a", "", " ", "a\x1c b", "a\x85 b", "1 2  3\n\n 4", "  x", "x  y"]
    rng = random.Random(4)
    odd += ["".join(rng.choice(" \n\tab'é你1! ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert all(enc.encode(t) == enc.whole(t) for t in odd)


def test_bin_completion_is_optimal_on_small_cases():
    def fewest(items, room):
        best = len(items)
        def place(i, bins):  # noqa: E306
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins)}.values():
                if bins[k] + items[i] <= room:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])
        items = sorted(items, reverse=True)
        place(0, [])
        return best

    rng = random.Random(8)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        plan = packing.plan(Counter(items), 20)
        assert sum((Counter({s: n * p.times for s, n in p.items}) for p in plan), Counter()) == Counter(items)
        assert sum(p.times for p in plan) == fewest(items, 20)


def groups(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(t.encode().lower())
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in seen[g])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            seen[g].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_join(spark, texts):
    root, size = groups(texts, 4, 85)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in queries.op4_ngram_jaccard_join(spark, TINY).collect()}
    assert got == {i: (root[i], size[i]) for i in texts}


def test_join_of_drifting_copies(spark):
    """Chains whose ends are far apart, groups that share a long passage, and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    out, passage = {}, [word() for _ in range(60)]
    for base in range(6):
        ws = [word() for _ in range(rng.choice((8, 14, 30, 90, 300)))]
        for k in range(12):
            out[base * 100 + k] = " ".join(ws)
            ws = ws.copy()
            ws[rng.randrange(len(ws))] = word()
    for k in range(25):
        out[1000 + k] = " ".join([*passage, *(word() for _ in range(rng.randint(3, 40)))])
    for k in range(40):
        ws = [f"t{j}" for j in range(rng.randint(1, 9))]
        out[2000 + k] = " ".join(ws)
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    root, size = groups(out, 4, 85)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.components(df, 4, 85).collect()}
    assert got == {i: (root[i], size[i]) for i in out}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    tops = ngram_join.band_tops(85, 3000)
    tops = np.r_[tops, tops[-1] * 100 // 85 + 2]
    schemes = {b: ngram_join.allocation(*ngram_join._bounds(tops, b), 85) for b in range(len(tops))}
    for _ in range(600):
        n = int(np.exp(rng.uniform(0, 7)))
        x = {int(v) for v in rng.integers(0, 2**62, n)}
        y = set(x)
        for _ in range(int(rng.integers(0, ngram_join.most_different(2 * n, 85) + 2))):
            if rng.random() < 0.5 and len(y) > 1:
                y.pop()
            else:
                y.add(int(rng.integers(0, 2**62)))
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        h = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (x, y)])
        owner, sig = ngram_join.signatures(h, np.array([0, len(x), len(x) + len(y)]), tops, schemes)
        assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_kneser_ney(spark, texts):
    toks = {i: [*WORD.findall(t.encode().lower()), b" end"] for i, t in texts.items()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pair = Counter(), Counter()
    for i in train:
        c.update(toks[i])
        pair.update(itertools.pairwise([b" start", *toks[i]]))
    after, n, follow, distinct = Counter(w for _, w in pair), Counter(), defaultdict(lambda: [0, 0, 0]), len(c)
    for (h, _), v in pair.items():
        n[h] += v
        follow[h][min(v, 3) - 1] += 1
    spread = lambda counts: [sum(v == k for v in counts) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(*spread(pair.values())), kneser_ney.discounts(*spread(after.values()))
    spare = sum(d * sum(min(v, 3) == k for v in after.values()) for k, d in enumerate(d1, 1)) / len(pair)

    def low(w):
        return (after[w] - d1[min(after[w], 3) - 1] if after[w] else 0) / len(pair) + spare / (distinct + 1)

    def p(h, w):
        if h not in n:
            return low(w)
        v = pair[h, w]
        return ((v - d2[min(v, 3) - 1]) if v else 0) / n[h] + sum(map(math.prod, zip(d2, follow[h], strict=True))) / n[h] * low(w)

    assert sum(p(b"the", w) for w in c) + p(b"the", b"never met") == pytest.approx(1)
    got = {r.doc_id: r for r in queries.op9_lm_scoring(spark, TINY).collect()}
    total = sum(c.values())
    for i, ts in toks.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(h, w)) for h, w in itertools.pairwise([b" start", *ts])), rel=1e-12)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ts), rel=1e-12)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(ts), sum(w in c for w in ts), total, i not in train)


def test_apportionment():
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.randint(0, 50) * rng.choice((1, 100)) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 300) if sum(votes) else 0
        have = [0] * len(votes)
        for _ in range(seats):
            have[max(range(len(votes)), key=lambda i: (votes[i] / (2 * have[i] + 1), -i))] += 1
        assert list(mixing.sainte_lague(np.array(votes), seats)) == have


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == []


def test_mix(spark, texts):
    docs = table(spark, TINY, "documents")
    mixed = mixing.mix(docs).toPandas()
    for _, rows in mixed.groupby("source"):
        assert rows["size"].sum() == rows.source_size.iloc[0] and abs(rows.taken.sum() - rows.target.iloc[0]) <= 16
    for r in mixed.itertuples():
        assert r.size == len(WORD.findall(texts[r.doc_id].encode())) and 0 <= r.taken <= 3 * r.size
    taken = mixing.select_texts(docs).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.doc_id: r.n for r in taken.collect()} == {r.doc_id: r.taken for r in mixed.itertuples() if r.taken}


# Pseudonyms, once more in plain Python.


def prf(key, tweak, r, value):
    return int(hashlib.sha256(f"{key}|{tweak}|{r}|{value}".encode()).hexdigest()[:15], 16)


def feistel(v, a, b, key, tweak):
    l, r = divmod(v, b)  # noqa: E741
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            l = (l + prf(key, tweak, k, r) % a) % a  # noqa: E741
        else:
            r = (r + prf(key, tweak, k, l) % b) % b
    return l * b + r


def digits(d, key, tweak):
    out = ""
    for k in range(0, len(d), 16):
        part, before = d[k : k + 16], d[:k]
        half = len(part) // 2
        if len(part) == 1:
            out += str((int(part) + prf(key, tweak + before, 0, "single") % 10) % 10)
        else:
            out += str(feistel(int(part), 10**half, 10 ** (len(part) - half), key, tweak + before + str(len(part)))).zfill(len(part))
    return out


def shifted(s, key, tweak):
    alpha = next((a for a in ("0123456789abcdef", "0123456789ABCDEF") if s and all(c in a for c in s)), None)
    parts = [s[k : k + pii.CHUNK] for k in range(0, len(s), pii.CHUNK)]
    return "".join(swept(x, key, f"{tweak}/{k}/{parts[0]}" if k else tweak, alpha) for k, x in enumerate(parts))


def swept(s, key, tweak, alpha):
    classes = (alpha,) if alpha else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for r in (0, 1):
        acc = ""
        for c in s:
            own = next((a for a in classes if c in a), None)
            acc += own[(own.index(c) + prf(key, f"{tweak}{len(acc)}", r, acc) % len(own)) % len(own)] if own else c
        s = acc[::-1] if r == 0 else acc
    return s[::-1]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))


def test_pseudonyms_against_plain_python(spark):
    rng = random.Random(9)
    key = "k"

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return body + str(-luhn(body + "0") % 10)

    cards = [card() for _ in range(60)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(60)]
    phones = [f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04}" for _ in range(60)]
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    emails = [f"ab{rng.randint(0, 9)}c.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com" for _ in range(60)]
    bad = ["4111111111111112", "300.1.1.1", "2023-02-30", "1.2.3", "12345"]
    text = "; ".join([*cards, *ips, *phones, *(f'token = "{s}"' for s in secrets), *emails, *bad])
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    one, two = pii.pseudonymise(df, key).orderBy("doc_id").collect()
    assert one.text == two.text and one.pii_found == 300 and one.pii_kinds == "card,email,ip,phone,secret"

    def plain_card(d):
        x = d[0] + digits(d[1:-1], key, "card" + d[0])
        return x + str(-luhn(x + "0") % 10)

    def plain_ip(s):
        v = feistel(int.from_bytes(map(int, s.split("."))), 65536, 65536, key, "ip")
        return ".".join(map(str, v.to_bytes(4)))

    def plain_phone(s):
        d = re.sub(r"\D", "", s)
        n = d[-10:]
        p = digits(n[1:3] + n[4:], key, "phone" + n[0] + n[3])
        new = iter(d[:-10] + n[0] + p[:2] + n[3] + p[2:])
        return re.sub(r"\d", lambda m: next(new), s)

    def plain_email(s):
        stem, tld = s.rsplit(".", 1)
        local, host = stem.split("@")
        return shifted(local, key, "local") + "@" + shifted(host, key, "domain") + "." + tld

    want = [*map(plain_card, cards), *map(plain_ip, ips), *map(plain_phone, phones), *(f'token = "{shifted(s, key, "secret")}"' for s in secrets), *map(plain_email, emails), *bad]
    assert one.text.split("; ") == want
    assert all(luhn(c) % 10 == 0 for c in want[:60]) and len(set(want)) == len(set(text.split("; ")))
    firsts = Counter(shifted(s, key, "secret")[0] for s in (f"{i:040x}" for i in range(1600)))
    assert len(firsts) == 16 and max(firsts.values()) < 160


def test_numbers_side_by_side(spark):
    """A number beside a valid one does not hide it."""
    rows = ["126 4880761348116108 27", "+1 (836) 555-9331 4913187196670932 53", "at 1.2.3.4, 4111 1111 1111 1111 22", "4111-1111-1111-1111."]
    rows = [t.replace("4880761348116108", "4111111111111111").replace("4913187196670932", "4111111111111111") for t in rows]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in rows], "text string"), "k").collect()]
    assert not any(re.search(r"4111.?1111|1\.2\.3\.4|555-9331", t) for t in got)
    assert [re.sub(r"\d", "9", t) for t in got[:2]] == [re.sub(r"\d", "9", t) for t in rows[:2]] and got[0].startswith("126 ") and got[0].endswith(" 27")


def test_dates_ssn_iban(spark):
    text = "on 2024-02-29, 31/12/1999 and 01.03.1987; 123-45-6789, not 000-45-6789; DE89370400440532013000, not DE88370400440532013000"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pseudonymise(df, "k").first()
    assert r.pii_found == 5 and r.pii_kinds == "date,iban,ssn"
    iban = re.findall(r"DE\d{20}", r.text)
    assert iban[1] == "DE88370400440532013000" and iban[0] != "DE89370400440532013000" and int(iban[0][4:] + "1314" + iban[0][2:4]) % 97 == 1
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2000-12-31')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("text"))
    got = [x.text for x in pii.pseudonymise(days, "k").collect()]
    assert len(set(got)) == 366 and all(re.fullmatch(r"(1[6-9]|2[0-4])\d\d-\d\d-\d\d|\d{4}-\d\d-\d\d", g) for g in got)


def test_packing_search_needs_little_memory():
    import tracemalloc

    rng = random.Random(1)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(40_000))
    tracemalloc.start()
    plan = packing.plan(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(p.times for p in plan) == -(-sum(s * n for s, n in counts.items()) // 2048) and peak < 50e6
    # every undominated filling is enumerated if asked for
    left = [0] * 21
    for s in (2, 3, 5, 7, 9):
        left[s] = 2
    found = {items for _, items in packing.fillings(left, sum(1 << s for s in (2, 3, 5, 7, 9)), 11, 9, 20, 4, lambda: None)}
    assert {((9, 1), (2, 1)), ((7, 1), (2, 2)), ((5, 2),), ((5, 1), (3, 2)), ((5, 1), (3, 1), (2, 1))} & found >= {((9, 1), (2, 1)), ((7, 1), (2, 2)), ((5, 1), (3, 2))}
    assert all(11 - w == sum(s * n for s, n in f) for w, f in packing.fillings(left, sum(1 << s for s in (2, 3, 5, 7, 9)), 11, 9, 20, 4, lambda: None))


def test_mix_is_the_same_each_time(spark):
    """Rows of one id, source and size whose texts or languages differ."""
    rows = [(i % 7 if i % 5 else None, f"{'ab'[i % 2]} x {i % 3}", "en" if i % 4 else None, f"s{i % 4}") for i in range(400)]
    both = [spark.createDataFrame(random.Random(k).sample(rows, len(rows)), "doc_id long, text string, lang string, source string").repartition(k) for k in (2, 5)]
    one, two = (sorted(map(str, mixing.select_texts(df).collect())) for df in both)
    assert one == two and one


def test_near_duplicates_judge_rows(spark):
    """A text is judged by itself, whatever else bears its id; rows without an id are judged too."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (None, b, "en"), (None, a, "de"), (3, a, "fr"), (9, "", "en"), (9, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(3, a, "en"), (7, b, "en"), (9, "", "en"), (9, "", "en")], key=str)
