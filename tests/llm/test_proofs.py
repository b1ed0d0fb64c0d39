"""Cases that once went wrong or that no test held: null page ids, scores beyond a long, pairs of neutral terms, ties of
neighbours, EM by plain Python, further orders of a large component."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_dedup, pii, quality_classifier, quality_rules, staging, toxicity, voronoi, warc


def test_pages_without_an_id_revisit_the_response(spark):
    rows = [(None, "u", "same"), (3, "u", "same"), (5, "u", "same"), (None, "v", "same"), (None, "u", "alone"), (None, "w", None), (7, "x", ""), (None, "y", "twice"), (None, "y", "twice"), (9, "z", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda **k: Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(pages, staging.new_path(spark, "warc"), **k)).collect())
    want = Counter({(None, 4, "revisit", 3): 2, (3, 4, "response", None): 1, (5, 4, "revisit", 3): 1, (None, 5, "response", None): 3, (None, 0, "revisit", 7): 1, (7, 0, "response", None): 1, (9, 4, "response", None): 1})
    assert read() == want
    assert read(least=5) == Counter({(i, len(h or ""), "response", None): n for (i, h), n in Counter((i, h) for i, _, h in rows).items() if len(h or "") != 4} | {(None, 4, "response", None): 2, (3, 4, "response", None): 1, (5, 4, "response", None): 1, (9, 4, "response", None): 1, (None, 5, "response", None): 3})


def test_scores_that_no_long_holds_are_errors(spark):
    df = lambda *v: spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        voronoi.top_k(df([1e17, 1.0], [1.0, 2.0])).collect()
    with pytest.raises(Exception, match="doesn't fit a long"):
        voronoi.top_k(df([1e16, 1.0], [1e16, 2.0])).collect()
    a, b = np.array([[3_000_000_000, -5]]), np.array([[1_000_000_000, 7], [2_000_000_000, 1]])
    assert voronoi.products(a, b).tolist() == [[3 * 10**18 - 35, 6 * 10**18 - 5]]
    assert {tuple(r) for r in voronoi.top_k(df([1e7, 1.0], [1e7, 2.0], [-1e7, 0.0]), k=1).collect()} == {(0, 1, 1, 256**2 * (10**14 + 2))}


def area(scores, y):
    pairs = [(s > t) + 0.5 * (s == t) for s in scores[y == 1] for t in scores[y == 0]]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("toxic", [lambda a, b: a == b, lambda a, b: a != b])
def test_pairs_of_neutral_terms(toxic):
    """Neither term tells anything alone: a linear model stays at 0.5."""
    rng = np.random.default_rng(2)
    held, y = [], []
    for i in range(3000):
        a, b = i % 2, i // 2 % 2
        words = [f"w{k}" for k in rng.integers(0, 300, 40)] + ["first"] * a + ["second"] * b
        held.append(toxicity.terms(" ".join(words).encode()))
        y.append(float(toxic(a, b)))
    y = np.array(y)
    model = toxicity.fit(held[:2400], y[:2400], steps=1000)
    assert area(np.array([model.score(r) for r in held[2400:]]), y[2400:]) > 0.95
    linear = toxicity.FactorizationMachine(model.place, model.bias, model.weight, np.zeros_like(model.factor))
    assert 0.4 < area(np.array([linear.score(r) for r in held[2400:]]), y[2400:]) < 0.6


def test_neighbours_by_plain_python():
    """Exact votes of the k nearest, those that tie by their place in the model; the same in blocks of any size."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, rng.integers(3, 30))).encode() for _ in range(120)]
    texts += [texts[5]] * 30 + [b"", b""]
    counted = [quality_classifier.counts(t) for t in texts]
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    model = quality_classifier.fit(counted[:140], y[:140], rank=8, k=7)
    got = model.scores(counted)
    again = np.concatenate([model.scores(counted[i : i + 11]) for i in range(0, len(counted), 11)])
    assert got.tolist() == again.tolist()

    def projected(at, v):
        v = [x * model.idf[i] for i, x in zip(at, v, strict=True)]
        for of, share in ((lambda i: i < quality_classifier.WORDS, 2), (lambda i: i >= quality_classifier.WORDS, 1)):
            norm = max(1e-9, math.sqrt(sum(x * x for i, x in zip(at, v, strict=True) if of(i))))
            v = [x / (share * norm) if of(i) else x for i, x in zip(at, v, strict=True)]
        out = [sum(x * float(model.basis[i, c]) for i, x in zip(at, v, strict=True)) for c in range(model.basis.shape[1])]
        norm = max(1e-9, math.sqrt(sum(x * x for x in out)))
        return [x / norm for x in out]

    for (at, v), score in zip(counted, got, strict=True):
        own = projected(at.tolist(), v.tolist())
        like = [round(sum(a * float(b) for a, b in zip(own, vector, strict=True)), 9) for vector in model.vectors]
        near = sorted(range(len(like)), key=lambda i: (-like[i], i))[: model.k]
        weight = [max(like[i], 1e-6) for i in near]
        assert score == pytest.approx(sum(w * model.label[i] for w, i in zip(weight, near, strict=True)) / sum(weight), abs=1e-6)


@pytest.mark.parametrize("seen", [50, 1 << 20])
def test_further_orders_that_settle_nothing(spark, monkeypatch, seen):
    """Heads that one component holds alone go, those of a single class among them; all that two components hold stay."""
    monkeypatch.setattr(near_dedup, "SEEN", seen)
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(-(1 << 62), 1 << 62, n).tolist()
    both, within = draw(40), draw(40)
    rows = [(i, 9, b"m", [*draw(54), *rng.choice(both, 3).tolist(), *(rng.choice(within, 3).tolist() if i < 300 else draw(3))], 1 if i < 300 else i) for i in range(400)]
    own = spark.createDataFrame(rows, "rep long, m long, marks binary, heads array<long>, c long").repartition(7)
    got = {r.rep: (r.m, bytes(r.marks), r.c, r.heads) for r in near_dedup.opened(own).collect()}
    holders = {}
    for _, _, _, heads, c in rows:
        for h in heads:
            holders.setdefault(h, set()).add(c)
    needed = 0
    for rep, m, marks, heads, c in rows:
        want = [h for h in heads if len(holders[h]) > 1]
        needed += len(want)
        assert got[rep][:3] == (m, marks, c) and [h for h in got[rep][3] if len(holders[h]) > 1] == want
    assert needed <= sum(len(x[3]) for x in got.values()) < 1.1 * needed + 50
    assert near_dedup.opened(own.limit(0)).count() == 0


def test_near_copies_in_one_component_and_strays(spark):
    """A large group of near copies beside texts that link with a few of its members only: equal to brute force."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(260):
        words = list(base)
        for k in rng.choice(60, 2, replace=False) if i else []:
            words[k] = f"x{i}{k}"
        texts.append(" ".join(words))
    for i in range(12):
        words = texts[20 * i].split()
        words[30 - i] = "stray"
        texts.append(" ".join(words[: 60 - i]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = {r.doc_id: r.component_id for r in near_dedup.link(docs, crowd=8).collect()}
    assert got == dict(enumerate(root))


def em(patterns, prior, hit, miss, strength=0.02, rounds=60):
    """Expectation-maximisation over (votes, rows) by numpy: the posterior of each pattern."""
    votes, n = np.array([v for v, _ in patterns]), np.array([k for _, k in patterns], float)
    weight = max(1.0, strength * n.sum())
    share, a, b = prior, np.full(votes.shape[1], hit), np.full(votes.shape[1], miss)

    def posterior():
        z = np.log(share / (1 - share)) + ((votes > 0) * np.log(a / b) + (votes < 0) * np.log((1 - a) / (1 - b))).sum(axis=1)
        return 1 / (1 + np.exp(-z))

    for _ in range(rounds):
        p = posterior()
        said, yes = (votes != 0) * n[:, None], (votes > 0) * n[:, None]
        share = (p @ n + weight * prior) / (n.sum() + weight)
        a = (p @ yes + weight * hit) / (p @ said + weight)
        b = ((1 - p) @ yes + weight * miss) / ((1 - p) @ said + weight)
    return posterior()


def test_quality_posterior_by_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.score(docs).collect()}
    vote = lambda bad, good: -1 if bad else int(good)
    votes = {}
    for i, r in got.items():
        n = max(r.n_words, 1)
        per = [r.n_symbols / n, r.n_upper / max(r.word_chars, 1), r.n_dup_lines / max(r.n_lines, 1), r.n_repeat_words / n, r.n_loud / n, r.word_chars / n, r.n_function / n]
        some = r.n_words > 0
        votes[i] = (
            vote(per[0] > 0.25, some and per[0] <= 0.05), vote(per[1] > 0.3, some and per[1] < 0.1), vote(per[2] > 0.3, some and r.n_dup_lines == 0), vote(per[3] > 0.4, some and per[3] < 0.15),
            vote(per[4] > 0.3, some and per[4] < 0.1), vote(per[5] < 2.5 or per[5] > 12, some and 3.5 <= per[5] <= 9), vote(per[6] < 0.02, some and per[6] >= 0.1),
        )
    patterns = sorted(Counter(votes.values()).items())
    of = dict(zip([v for v, _ in patterns], em(patterns, 0.9, 0.99, 0.75), strict=True))
    for i, r in got.items():
        assert r.quality_posterior == pytest.approx(of[votes[i]], abs=1e-9)
        assert r.kept == (not r.base_failed and of[votes[i]] >= 0.5)
    assert {r.kept for r in got.values()} == {True, False}


def test_spans_by_plain_python(spark):
    """From the labelers' votes on: EM for each kind, the logistic span model, base spans and what it adds."""
    texts = ["write to a.b@c.de or x@y.zz1", "call (222) 555-0199 or +1 222 555 0199 today", "version 1.2.3.4 host 10.0.0.1 and 999.10.10.10", "card 4111 1111 1111 1111, card 4111 1111 1111 1112, order 1234567890123", "tel 222-555-0199, isbn 222-555-0198", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    rows = docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()
    counts = Counter((x.kind, tuple(x[f"v{j}"] for j in range(5))) for r in rows for x in r.c)
    features, soft, weight = [], [], []
    for kind in pii.KINDS:
        own = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        for (v, n), p in zip(own, em(own, 0.6, 0.8, 0.2) if own else [], strict=True):
            features.append([float(kind == k) for k in pii.KINDS] + [float(x == s) for x in v for s in (1, -1)])
            soft.append(p)
            weight.append(n)
    x, y, n = np.array(features), np.array(soft), np.array(weight, float)
    w, bias, speed = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1] + 1, 1e-8)
    for _ in range(400):
        e = (1 / (1 + np.exp(-(x @ w + bias))) - y) * n / n.sum()
        g = np.append(1e-3 * w + e @ x, e.sum())
        speed += g * g
        step = 0.5 * g / np.sqrt(speed)
        w, bias = w - step[:-1], bias - step[-1]
    z = {(k, v): bias + np.dot(w, [float(k == q) for q in pii.KINDS] + [float(a == s) for a in v for s in (1, -1)]) for k, v in counts}
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    added = 0
    for r in rows:
        base = [c for c in r.c if c.base]
        more = [c for c in r.c if not c.base and z[c.kind, tuple(c[f"v{j}"] for j in range(5))] >= 0 and not any(b.kind == c.kind and b.s < c.e and c.s < b.e for b in base)]
        added += len(more)
        assert got[r.doc_id] == ",".join(f"{c.kind}:{c.s}:{c.e}" for k in pii.KINDS for c in sorted((c for c in base + more if c.kind == k), key=lambda c: (c.s, c.e)))
    assert added
