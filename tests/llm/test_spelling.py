import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and b[same + 1 :] == a[same:]


def plain(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(others))
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, *out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def found(df):
    return sorted(map(tuple, spelling.spelling_variants(df).collect()))


@pytest.mark.parametrize("letters,lengths", [("ab", (5, 8)), ("abc", (5, 7)), ("abcdefghÀéÿ", (5, 12)), ("aB", (62, 68))])
def test_against_all_pairs(spark, letters, lengths):
    rng = random.Random(len(letters))
    words = ["".join(rng.choices(letters, k=rng.randint(*lengths))) for _ in range(60)]
    for w in list(words):  # and some one edit apart
        i = rng.randrange(len(w))
        words += [w[:i] + rng.choice(letters) + w[i + rng.randrange(2) :], w[:i] + w[i + 1 :]]
    docs = [(d, " ".join(rng.choice(words) for _ in range(60)) + rng.choice(("\n", ".", "1"))) for d in range(40)]
    docs += [(None, " ".join(words)), (1, None), (2, ""), (3, " ".join(words)), (3, " ".join(words))]
    want = plain(docs)
    assert len(want) > 20 and any(r[1] for r in want)
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == want


def test_pivots_are_disjoint_and_least():
    rng = random.Random(3)
    for _ in range(300):
        w = "".join(rng.choices("abcd", k=rng.randint(5, 11)))
        numbers = {a + b: rng.randint(1, 9) for a in "abcd" for b in "abcd"}
        places = spelling.prefix(w, numbers)
        cost = lambda i, j: numbers[w[i : i + 2]] + numbers[w[j : j + 2]]  # noqa: B023, E731
        i, j = spelling.pivots(w, places, numbers)
        assert i + 2 <= j and cost(i, j) == min(cost(a, b) for a in places for b in places if a + 2 <= b)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(1, None), (None, ""), (2, "abcd")], schema)) == []
    run = "".join(random.Random(1).choices("abcdefghij", k=20_000))
    docs = [(i, f"{run} {run[:-1]}x {run[1:]} {run[:900]}z{run[900:]} {run[::-1]} tower") for i in range(4)]
    df = spark.createDataFrame(docs, schema).select("*", F.lit("mine").alias("word"), F.lit("mine").alias("n"), F.lit("mine").alias("key"))
    assert found(df) == plain(docs)


def test_keys_and_words_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Spark takes a table of keys for as small as that of the words, and a written one for as small as its file."""
    words = spark.sql("SELECT * FROM VALUES ('hello', 9L), ('hallo', 3L), ('jello', 4L), ('others', 5L) AS t(word, n)")
    pairs = spelling.near_pairs(words)
    assert pairs.count() == 4 and "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "FEW", 0)
    plans, plain = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    forms = spark.sql("SELECT * FROM VALUES ('hello', NULL), ('hallo', 'hello'), ('hall', 'hallo') AS t(word, form)")
    assert sorted(map(tuple, spelling.roots(forms).collect())) == [("hall", "hello"), ("hallo", "hello"), ("hello", "hello")]
    assert len(plans) == 4 and not any("BroadcastExchange" in p for p in plans)
