import random

import numpy as np

import corpus_pipeline
from lodestone.llm import shingles
from tests.llm.test_simhash import brute_components, brute_fingerprint


def plain_sets(docs):
    out = {}
    for d, t in docs.items():
        w = (t or "").lower().split()
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_kept(docs):
    """The least id of each component of links by fingerprint or by Jaccard similarity of all pairs."""
    component = brute_components([(d, brute_fingerprint(t)) for d, t in docs.items()])
    sets = plain_sets(docs)
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] & sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            lo, hi = sorted((component[a], component[b]))
            if lo != hi:
                component = {d: lo if c == hi else c for d, c in component.items()}
                changed = True
    return {d for d in docs if component[d] == d}, links


def test_near_copies_down_to_the_threshold(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    docs, d = {}, 0
    for group in range(12):
        base = [word() for _ in range(rng.choice((60, 150, 400)))]
        for changes in (0, 1, 2, 3, 5, 8, 12):
            mine = list(base)
            for i in rng.sample(range(len(mine)), changes):
                mine[i] = word()
            docs[d] = " ".join(mine)
            d += 1
    docs |= {d: "", d + 1: None, d + 2: "a b", d + 3: "A  b"}
    want, links = plain_kept(docs)
    fp = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in links) > 10
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").collect() == []


def plain_pairs(sets, labels):
    return {(i, j) for i in range(len(sets)) for j in range(i) if labels[i] != labels[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}


def groups(n, pairs):
    parent = list(range(n))
    for i, j in pairs:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_bounds_lose_no_pair_and_sets_decide():
    rng = np.random.default_rng(5)
    for size in (3, 40, 127, 130, 700):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets = [set(base.tolist())]
        for _ in range(25):
            mine = list(sets[rng.integers(len(sets))])
            for _ in range(rng.integers(0, max(2, size // 8))):
                mine[rng.integers(len(mine))] = int(rng.integers(0, 2**63))
            sets.append(set(mine[: len(mine) - int(rng.integers(0, max(1, size // 10)))]))
        labels = np.arange(len(sets)) // 2
        data = [np.array(sorted(s), "<u8") for s in sets]
        want = plain_pairs(sets, labels)
        sizes = np.array([len(s) for s in sets])
        maps = [shingles.bitmap(d) for d in data]
        may = {(i, int(j)) for i, js in shingles.possible(labels, sizes, maps) for j in js}
        assert want <= may
        # With labels as nodes that are connected from the start.
        same = [(i, i - 1) for i in range(1, len(sets), 2)]
        got = shingles.similar_pairs(labels, sizes, [d.tobytes() for d in data])
        assert set(got) <= want and groups(len(sets), [*got, *same]) == groups(len(sets), [*want, *same])
        kept = shingles.forest(labels, sizes, [m.tobytes() for m in maps])
        assert set(kept) <= may and groups(len(sets), kept) == groups(len(sets), may)


def test_large_groups_in_slices(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SLICE_ROWS", 5)
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    docs = {}
    for d in range(60):  # a chain of copies, each with a few other words, and texts that share a passage only
        if d % 3:
            base[rng.randrange(len(base))] = f"v{d}"
        docs[d] = " ".join(base) if d % 5 else " ".join([*base[:50], *(f"z{d}.{i}" for i in range(25))])
    want, _ = plain_kept(docs)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == sorted(want)
