import hashlib
import random
import re

import pytest

from lodestone.llm import exact, queries

SCHEMA = "doc_id long, text string"


def plain(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) by definition."""
    groups = {}
    for d, t in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(t, []).append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def found(df, **options):
    rows = exact.exact_duplicates(df, **options)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in rows.collect()), key=repr)


def sample(rng, n):
    words = ["alpha", "beta", "γάμμα", "delta"]
    space = [" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "]
    texts = ["".join(rng.choice(words) + rng.choice(space) for _ in range(rng.randrange(6))) for _ in range(n // 3)]
    texts += ["", None, " ", "\n\n", " ", "a b", "a b", " a b", "a b "]
    return [(i, rng.choice(texts)) for i in range(n)] + [(None, "alpha "), (None, "alone"), (3, "alpha\n"), (3, "alpha\n")]


@pytest.mark.parametrize("options", [{}, {"group": 3}, {"huge": 8, "chunk": 8}, {"chunk": 4}, {"group": 4, "huge": 8, "chunk": 8, "primes": (5, 7)}, {"group": 2, "primes": (3, 5)}])
def test_against_the_definition(spark, options):
    rows = sample(random.Random(5), 120)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), **options) == plain(rows)


def test_chunks_compose():
    p, rng = exact.Fingerprint(), random.Random(1)
    data = rng.randbytes(3 * exact.CHUNK + 77)
    h = 0
    for b in data:
        h = (h * p.points[0] + b + 1) % p.primes[0]
    assert p.whole(data)[:2] == (len(data), h)
    for at in (0, 1, 1000, exact.CHUNK, 2 * exact.CHUNK + 5, len(data)):
        assert p.join(p.whole(data[:at]), p.whole(data[at:])) == p.whole(data)


def test_very_long_texts_and_a_changed_byte(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(("some", "few", "words")) for _ in range(400_000))
    other = long[:-2] + "x" + long[-1:]
    rows = [(1, long), (2, long.replace(" ", "\n ")), (3, other), (4, other), (5, long[:-1])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [("b", "x"), ("a", "x "), ("c", "x ")]
    df = spark.createDataFrame(rows, "doc_id string, text string").select("*", *[F.lit(n).alias(n) for n in ("id", "sha", "h1", "copy", "slice", "keep_id")])
    assert found(df) == plain(rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_exact_duplicates(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == plain(rows)
