import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import ppm, queries
from tests.llm.test_simhash import lower, WORD


def brute_log10(train, context, symbol, order):
    """Method C with symbol exclusion, straight from the definition. train: {context: Counter}."""
    excluded, p, entered = set(), 1.0, False
    for k in range(order, -1, -1):
        seen = train.get(context[len(context) - k :])
        if not seen:
            continue
        left = {s: c for s, c in seen.items() if s not in excluded}
        total = sum(left.values()) + len(left)
        if symbol in left:
            return math.log10(p * left[symbol] / total)
        if left:
            p *= len(left) / total
        excluded |= set(left)
        entered = True
    return math.log10(p / max(1, 256 - len(train.get(b"", ()))))


def brute_train(texts, order):
    train = defaultdict(Counter)
    for t in texts:
        data = bytes([ppm.BEFORE]) * order + t + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                train[data[i - k : i]][data[i]] += 1
    return train


def brute_score(counts, text, order):
    data = bytes([ppm.BEFORE]) * order + text + b"\xff"
    return sum(brute_log10(counts, data[i - order : i], data[i], order) for i in range(order, len(data)))


@pytest.mark.parametrize(("order", "hot_grams"), [(1, 10**6), (3, 40), (5, 0)])
def test_scores(spark, order, hot_grams):
    rng = random.Random(order)
    text = lambda n: "".join(rng.choice(["the ", "an", "d ", "é", "x", "."]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(61, ""), (62, None), (63, "zzzz unseen \x00"), (64, "中"), (65, text(20)), (None, "qq"), (63, "zz" * 40)]
    counts = brute_train([lower(t or "").encode() for d, t in docs if not ppm.is_held_out(d)], order)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.score) for r in ppm.score(df, order=order, hot_grams=hot_grams).collect())
    want = sorted((repr(d), brute_score(counts, lower(t or "").encode(), order)) for d, t in docs)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_probabilities_are_whole(spark):
    texts = ["the cat and the hat", "the dog", "ant"]
    counts = ppm.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 3)
    for context in (b"the", b"zhe", b"zze", b"zzz"):
        grams = spark.createDataFrame([(int.from_bytes(context + bytes([s]), "big"),) for s in range(256)], "gram long")
        rows = ppm.probabilities(grams, counts, 3).collect()
        assert len(rows) == 256 and abs(sum(10**r.p for r in rows) - 1) < 1e-9


def test_no_training_texts(spark):
    df = spark.createDataFrame([(i, "ab") for i in range(40) if ppm.is_held_out(i)], "doc_id long, text string")
    assert all(math.isclose(r.score, -3 * math.log10(256)) for r in ppm.score(df).collect())


def test_long_texts_in_parts(spark, monkeypatch):
    texts = [b"abcdefgh" * 5, b"", b"xyz"]
    whole = [(o.tolist(), k.tolist()) for o, k in ppm.windows(texts)]
    monkeypatch.setattr(ppm, "STRETCH", 7)
    parts = [(o.tolist(), k.tolist()) for o, k in ppm.windows(texts)]
    assert len(parts) > 5 and [x for o, _ in parts for x in o] == whole[0][0] and [x for _, k in parts for x in k] == whole[0][1]
    assert len(whole[0][0]) == sum(len(t) + 1 for t in texts)


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 5000).astype(np.uint64))
    t = ppm.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()
    assert (ppm.Table(keys[:0]).find(keys) == -1).all()


def brute_base(docs):
    tokens = {i: WORD.findall(lower(t)) + [None] for i, (_, t) in enumerate(docs)}
    counts = Counter(w for i, (d, _) in enumerate(docs) if not ppm.is_held_out(d) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return [(d, ppm.is_held_out(d), len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_base(spark, hot):
    docs = [(i % 23, t) for i, t in enumerate(["The cat and the hat", None, "", "a b\x0bc", "THE end " * 400, "the cat", "é É xyz"] * 5)] + [(None, "null id"), (3, "the cat")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r)[:6] for r in ppm.score(df, hot=hot).collect()), key=key)
    for g, w in zip(got, sorted(brute_base(docs), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    assert ppm.score(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in queries.op5_ppm_scores(spark, sf_dir).collect()}
    train = [lower(t).encode() for d, t in docs if not ppm.is_held_out(d)]
    counts, single = brute_train(train, ppm.ORDER), brute_train(train, 0)
    assert len(rows) == len(docs)
    for d, held, n, known, total, base in brute_base(docs):
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    for d, t in docs:
        if ppm.is_held_out(d) or d % 4 == 0:
            assert math.isclose(rows[d].score, brute_score(counts, lower(t).encode(), ppm.ORDER), rel_tol=1e-9)
    # Contexts must help on texts that were not learned from.
    held = [(d, lower(t).encode()) for d, t in docs if ppm.is_held_out(d)]
    assert sum(rows[d].score for d, _ in held) > 0.75 * sum(brute_score(single, t, 0) for _, t in held)
