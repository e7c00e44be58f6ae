import random

import xxhash
import pytest

from lodestone.llm import queries, simhash
from lodestone.llm.components import connected_components
from tests.llm.brute import WORD


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=4):
    """{doc: least doc reachable}, over [(doc, fingerprint)]."""
    left, out = dict(pairs), {}
    for d in sorted(left):
        if d in out:
            continue
        todo, out[d] = [d], d
        while todo:
            x = todo.pop()
            for y in left:
                if y not in out and (left[x] ^ left[y]).bit_count() <= radius:
                    out[y] = d
                    todo.append(y)
    return out


TEXTS = [None, "", " \t", "a", "A b", "a b c d", "A B c d e f", "é É x y z", "a\x0bb\x0cc\rd e", "word " * 70000, "x\xa0y z w v", "a b c d a b c d a b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_tree_finds_every_link():
    rng = random.Random(1)
    for n in (1, 2, 30, 300):
        seeds = [rng.getrandbits(64) for _ in range(max(1, n // 10))]
        values = list({rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(n)})
        got = {}
        for v, m in simhash.shard_links(values, 4):
            got.setdefault(m, {m}).add(v)
        want = {}
        for v, c in brute_components([(v, v) for v in values]).items():
            want.setdefault(c, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_links_with_slices(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(i, s) for i, s in enumerate(signed)] + [(1000 + i, s) for i, s in enumerate(signed[:5])], "doc_id long, fp long")
    edges = simhash.fingerprint_links(prints.select("fp").distinct(), shard_rows=16)
    labels = {r.node: r.label for r in connected_components(edges).collect()}
    want = brute_components(list(enumerate(values)))
    for i, s in enumerate(signed):
        assert labels.get(s, s) == min(signed[j] for j in want if want[j] == want[i])
    rows = {r.doc_id: r.component_id for r in simhash.with_component(prints, "doc_id").collect()}
    assert rows == want | {1000 + i: want[i] for i in range(5)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_rows_with_odd_values(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "A", "again"), (None, "", "null id"), (None, "only null ids have this text here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id is null").count() == 1 and kept.where("text is null").count() == 1
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(list(prints.items()))
    got = queries.op2_simhash_near_duplicates(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
