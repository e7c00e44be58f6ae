import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    """(depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) of each node, by definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = dict(own)
    for c in own if rebuild else ():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(nodes[p]) - 1) * len(p[-1][1].decode()) if p else 0)
        if p:
            up = p[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[p], saved.get(up, 0) + saved[p]
    end = lambda p: ",".join(str(c) for c in sorted(nodes[p]) if len(seqs[c]) == len(p))
    return sorted(((len(p), min(m), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(end(p).encode()).hexdigest()) for p, m in nodes.items()), key=repr)


def found(df, **options):
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends or empty) for r in conversations.prefix_trie(df, **options).collect()), key=repr)


def sample(rng, n):
    rows = []
    for c in rng.sample(range(-150, 450), n):
        if rng.random() < 0.4:  # many with the same turns
            texts = [("user", "hello"), ("assistant", "hi there"), ("user", "and now?"), ("assistant", "ütf")] * 2
            texts = texts[: rng.randrange(1, 8)]
        else:
            texts = [(rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", None, "", "ccc"))) for _ in range(rng.randrange(1, 9))]
        turns = list(range(len(texts)))
        if rng.random() < 0.2:
            turns[0] = None
        if rng.random() < 0.2:
            turns = [t and t // 2 for t in turns]
        rows += [(c, t, *x) for t, x in zip(turns, texts, strict=True)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 6}, {"block": 3}, {"block": 2, "shard": 4, "rebuild": False}])
def test_against_the_definition(spark, options):
    rows = sample(random.Random(7), 130)
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), **options) == plain(rows, options.get("rebuild", True))


def test_hot_turn_and_long_conversation(spark):
    rng = random.Random(8)
    rows = [(c, t, "user", "the same start" if t < 2 else str(rng.randrange(3))) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(77, t, "user", "x" * (t % 3)) for t in range(400)] + [(78, t, "user", "x" * (t % 3)) for t in range(390)]
    assert found(spark.createDataFrame(rows, SCHEMA), block=64, shard=50) == plain(rows)


def test_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []
    rows = [(1, 0, "user", "y" * 3_000_000), (2, 0, "user", "y" * 3_000_000), (2, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("mine").alias(n) for n in ("conv", "pos", "id", "key", "f", "place", "n")])
    assert found(df) == plain(rows)
    assert found(df, rebuild=False) == plain(rows, False)
