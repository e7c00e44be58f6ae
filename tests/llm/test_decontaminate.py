import random

import numpy as np
import pyarrow as pa

from lodestone.llm import decontaminate as d
from lodestone.llm import queries


def sellers(pattern, text):
    """The least edits that turn the pattern into a stretch of the text."""
    now = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(now[j - 1] + (p != t), now[j] + 1, new[j - 1] + 1))
        now = new
    return min(now)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("abcxyz")
        elif kind == 1:
            chars.insert(i, rng.choice("abcxyz"))
        else:
            del chars[i]
    return "".join(chars)


SYLLABLES = ["the", "tion", "er", "ou", "and ", "in", "re ", "éa", "st", "of "]


def prose(rng, n):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def test_search_agrees_with_full_alignment():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice((6, 20, 45, 90)))) for i in range(12)]
    index = d.build_index(items)
    texts = [d.normal(prose(rng, 60) + " " + edited(rng, rng.choice(items)[1], rng.randrange(14)) + prose(rng, rng.randrange(40))) for _ in range(80)] + ["", "short"]
    got = {(t, i, a): e for t, i, a, e, _, _ in d.search(texts, index)}
    n = 0
    for s, (item, at) in enumerate(zip(index.items, index.offsets)):
        segment = "".join(map(chr, index.segments[s]))
        for t, text in enumerate(texts):
            e = sellers(segment, text)
            want = e if e <= index.edits[s] else None
            n += want is not None
            # A band may hold a better stretch than the one with the least edits elsewhere, never a worse verdict.
            assert (got.get((t, item, at)) is None) == (want is None), (e, got.get((t, item, at)))
            if want is not None:
                assert got[t, item, at] == want
    assert n > 20


def test_align():
    pattern, region = d.code_points("abcdef"), d.code_points("zzabxdefzzzz")
    edits, end = d.align(pattern[None, :], np.array([6]), region[None, :])
    assert (edits[0], end[0]) == (1, 8)


def test_cut_covers():
    for n in (0, 5, 120, 180, 181, 500):
        parts = d.cut("x" * n)
        assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == n
        assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(parts, parts[1:]))


def test_slices_of_long_texts():
    rng = random.Random(6)
    item = prose(rng, 70)
    index = d.build_index([(1, item)])
    for shift in range(0, 400, 37):
        text = d.normal("x" * (900 + shift) + " " + item + " " + "y" * 700)
        batch = pa.RecordBatch.from_pydict({"t": [None, text, ""]})
        got = {}
        for piece in d.pieces(batch, "t", 500):
            for n, i, a, e, s, t in d.search([p[2] for p in piece], index):
                got[piece[n][0], i, a] = (e, piece[n][1] + s, piece[n][1] + t)
        assert got == {(1, i, a): (e, s, t) for _, i, a, e, s, t in d.search([text], index)} and got
        assert {f[:3]: f[3:] for f in d.search_rows(batch, "t", index)} == got


def test_frames(spark):
    rng = random.Random(9)
    items = [(1, prose(rng, 60)), (2, None), (3, ""), (4, "tiny"), (None, prose(rng, 60))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1].upper(), "k"), (2, None, "k"), (3, "", None), (4, prose(rng, 9000) + items[0][1] + prose(rng, 10), "k"), (5, prose(rng, 200), "k"), (1, items[0][1], "k"), (None, items[4][1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(2)
    # An extra column may share a name with the result's own.
    got = d.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (4, 1), (None, None)}
    for chars in (d.BLOCK_CHARS, 100):
        kept = d.clean_rows(docs, benchmark, block_chars=chars)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert d.contaminated(docs.limit(0), benchmark).collect() == []
    assert d.contaminated(docs, benchmark.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_benchmark_decontamination(spark, sf_dir).collect()}
    whole = {(i, j) for i, t in docs.items() for j, s in items.items() if s in t}
    assert whole and whole <= got
    for i, j in got - whole:
        assert any(sellers(s, docs[i]) <= 0.1 * len(s) for _, s in d.cut(items[j]))
