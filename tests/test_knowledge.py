"""Statements in time, confidence along facts and sources, ranks, histories, mentions of many questions, streams into graphs, product codes."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import building, retrieval, search, traversal, trust
from lodestone.schemas import ENTITIES, EVIDENCE, EXTRACTION, RELATIONSHIPS, Graph
from lodestone.skew import join_split
from lodestone.sources import snapshots
from lodestone.streaming.building import merge_batch
from tests.corpus import graph, simple_graph


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(days=n)
    rows = []
    for i in range(150):
        a, n = rng.randrange(2000), rng.choice((0, 1, 3, 40, 400, 3000, 40000))
        rows.append((i, rng.choice(("x", "x", "x", "y", None)), None if rng.random() < 0.1 else day(a), None if rng.random() < 0.1 else day(a + n), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id int, k string, valid_from date, valid_until date, no boolean").repartition(3)
    lo, hi = (lambda r: r[2] or datetime.date.min), (lambda r: r[3] or datetime.date.max)
    meets = lambda p, q: p[1] == q[1] and max(lo(p), lo(q)) < min(hi(p), hi(q)) and lo(p) < hi(p) and lo(q) < hi(q)
    want = sorted((p[0], q[0], max(lo(p), lo(q)), min(hi(p), hi(q))) for p in rows for q in rows if p[0] < q[0] and meets(p, q))
    for days in (1, 20, 90):
        got = trust.overlaps(df, ["k"], days=days)
        assert sorted((r.first_id, r.second_id, r.overlap_from, r.overlap_until) for r in got.collect()) == want
    got = trust.overlaps(df, ["k"], side=F.col("no")).collect()
    assert sorted((r.first_id, r.second_id) for r in got) == sorted((p[0], q[0]) for p in rows for q in rows if not p[4] and q[4] and meets(p, q))
    assert trust.overlaps(df.limit(0), ["k"]).collect() == []


def test_confidence_settles(spark):
    rng = random.Random(2)
    said = [(f"c{rng.randrange(12)}", f"r{rng.randrange(20)}", round(rng.random(), 2)) for _ in range(120)]
    evidence = spark.createDataFrame([(str(i), r, c, "", p, i) for i, (c, r, p) in enumerate(said)], EVIDENCE)
    best = {}
    for c, r, p in said:
        best[c, r] = max(best.get((c, r), 0), p)
    trusted = {c: 0.8 for c, _ in best}
    fact = lambda r: 1 - math.prod(1 - p * trusted[c] for (c, x), p in best.items() if x == r)
    rounds = 0
    while True:
        facts = {r: fact(r) for _, r in best}
        after = {c: 0.4 + 0.5 * sum(facts[r] for x, r in best if x == c) / sum(x == c for x, _ in best) for c in trusted}
        most, trusted, rounds = max(abs(after[c] - trusted[c]) for c in trusted), after, rounds + 1
        if most <= 1e-3:
            break
    got, sources, n = trust.propagated(evidence, change=1e-3)
    assert n == rounds
    assert {r.relationship_id: round(r.confidence, 6) for r in got.collect()} == {r: round(fact(r), 6) for _, r in best}
    assert {r.chunk_id: round(r.reliability, 6) for r in sources.collect()} == {c: round(t, 6) for c, t in trusted.items()}
    assert trust.propagated(evidence.limit(0))[0].collect() == []


def test_page_rank_and_closeness(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12), "USES", 1.0) for _ in range(30)] + [(i, 0, "USES", 1.0) for i in range(1, 10)]
    x = simple_graph(spark, 15, edges)
    n, ranks = 15, {i: 1 / 15 for i in range(15)}
    out = {i: sum(s == i for s, *_ in edges) for i in range(n)}
    for _ in range(4):
        idle = sum(r for i, r in ranks.items() if not out[i])
        ranks = {i: (0.15 + 0.85 * idle) / n + 0.85 * sum(ranks[s] / out[s] for s, t, *_ in edges if t == i) for i in range(n)}
    got = {int(r.id): r.rank for r in traversal.page_rank(x, 4).collect()}
    assert got == pytest.approx(ranks) and sum(got.values()) == pytest.approx(1)
    near = {i: {t for s, t, *_ in edges if s == i} | {s for s, t, *_ in edges if t == i} for i in range(n)}
    want = {}
    for i in range(n):
        seen, front, total = {i}, {i}, 0.0
        for hop in range(1, 5):
            front = {m for f in front for m in near[f]} - seen
            seen |= front
            total += len(front) / hop
        want[i] = total
    close = {int(r.id): r.closeness for r in traversal.harmonic_centrality(x, 4).collect()}
    assert close == pytest.approx(want, rel=0.1, abs=0.05)
    none = Graph(x.entities.limit(0), x.relationships.limit(0), x.evidence)
    assert traversal.page_rank(none).collect() == [] and traversal.harmonic_centrality(none, 1).collect() == []


def test_history_is_every_version(spark, tmp_path):
    x, path = graph(spark), str(tmp_path / "g")
    alias = F.when(F.col("id") == "API", F.array(F.lit("api"))).otherwise(F.col("aliases"))
    tables = [x.entities, x.entities.where("id <> 'API'"), x.entities.where("id <> 'API'"), x.entities.withColumn("aliases", alias), x.entities]
    saved = [snapshots.save_graph(Graph(t, x.relationships, x.evidence), path) for t in tables]
    found = snapshots.history(spark, path)
    spans = found.where("id = 'API'").orderBy("valid_from").collect()
    assert len(spans) == 3 and spans[-1].valid_until is None and all(s.valid_until is not None for s in spans[:-1])
    for r in snapshots.versions(spark, path).collect():
        want = tables[saved.index(r.version)]
        schema = want.select(sorted(want.columns)).schema.simpleString()
        got = snapshots.as_of(found, F.lit(r.saved_at), schema)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


NAMES = ["FastAPI", "C++", "c", "new york", "York", "New York City", "東京", "+", "a.b", "Zürich", " ", "x_y", "GPT-5", "...", "New"]
QUESTIONS = ["Does FastAPI run in New York City?", "c++ or C or c+", "a.b and axb, x_y", "東京 Zürich", "1+1 is +", "", None, "newyork", "GPT-5... or GPT-55", "zürich's York", "wait...what"]


def test_mentions_of_many_questions_are_those_of_each(spark):
    entities = spark.createDataFrame([(f"e{i}", n, "Concept", [NAMES[(i * 7) % len(NAMES)]] if i % 3 == 0 else [], None, None, i) for i, n in enumerate(NAMES)], ENTITIES)
    x = Graph(entities, spark.createDataFrame([], RELATIONSHIPS), spark.createDataFrame([], EVIDENCE))
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "question_id int, text string").repartition(2)
    got = {(r.question_id, r.entity_id) for r in retrieval.mentions_of(x, asked).collect()}
    want = {(i, r.id) for i, q in enumerate(QUESTIONS) if q is not None for r in retrieval.mentioned_entities(x, q).collect()}
    assert got == want and len(want) > 15
    assert retrieval.mentions_of(x, asked.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [1, 10, 10_000])
def test_mentions_by_hot_and_by_rare_words(spark, monkeypatch, hot):
    """No name without a letter, names of several entities, a first place inside a word, and texts that are not ASCII."""
    monkeypatch.setattr(retrieval, "HOT_TOKENS", hot)
    names = ["New York", "York", "Zürich", "C++", "x_y", "GPT-5", "York", "-dash", "東京", "new-york", "Élan"]
    texts = ["newyork York", "yorks, york", "Zürich? zürich's york", "c++x or c++", "a-dash -dash", "GPT-55 GPT-5", "x_y York, New York", "E\u0301lan of 東京", "-dash", "york", None, "", "new york-york", "zürichs", "new-york"]
    entities = spark.createDataFrame([(f"e{i}", n, "Concept", [], None, None, i) for i, n in enumerate(names)], ENTITIES)
    x = Graph(entities, spark.createDataFrame([], RELATIONSHIPS), spark.createDataFrame([], EVIDENCE))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "Zürich"), (1, "york")], "question_id int, text string").repartition(3)
    got = [(r.question_id, r.entity_id) for r in retrieval.mentions_of(x, asked).collect()]
    want = {(i, r.id) for i, q in [*enumerate(texts), (1, "Zürich")] if q is not None for r in retrieval.mentioned_entities(x, q).collect()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_batches_that_come_again_add_nothing(spark, tmp_path):
    rows = [(f"c{i:02}", [(f"Name {i % 7}", "Product"), (f"Other {i % 3}", "Concept")], [(f"Name {i % 7}", f"Other {i % 3}", "USES", "said", 0.1 * (i % 9))]) for i in range(24)]
    df = spark.createDataFrame(rows, f"chunk_id string, {EXTRACTION}")
    path = str(tmp_path / "graph")
    merge = merge_batch(path)
    for n, (a, b) in enumerate((("c00", "c08"), ("c08", "c16"), ("c08", "c16"), ("c16", "c99"), ("x", "y"))):
        merge(df.where(f"chunk_id >= '{a}' AND chunk_id < '{b}'"), n)
    got, (want, _) = snapshots.load_graph(spark, path), building.build_graph(df)
    for a, b in ((got.entities, want.entities), (got.relationships, want.relationships), (got.evidence, want.evidence)):
        columns = [c for c in b.columns if c != "ord"]
        assert [tuple(r) for r in a.orderBy("ord").select(columns).collect()] == [tuple(r) for r in b.orderBy("ord").select(columns).collect()]
    assert snapshots.versions(spark, path).count() == 4


def test_product_codes(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(1200)] + [(1200, [0.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 50 = 0 AND vec_id < 1200")
    index = search.build_codes(df)
    exact = {(r.query_id, r.id): r.score for r in search.batch_search(df, asked, 10).collect()}
    got = {(r.query_id, r.id): r.score for r in search.code_search(index, asked, 10).collect()}
    assert len(got) == len(exact) == 240
    assert sum(p in exact for p in got) >= 0.9 * len(exact)
    assert all(got[p] == pytest.approx(exact[p]) for p in got if p in exact)
    whole = search.code_search(index, asked, 10, share=1.0, block=7)
    assert {(r.query_id, r.id) for r in whole.collect()} == set(exact)
    assert search.code_search(index, asked.limit(0), 10).collect() == []


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1200)] + [(None, -1)], "k long, i long").repartition(5)
    side = spark.createDataFrame([(1, "one"), (950, "x"), (2000, "never")], "k long, v string")
    for how in ("inner", "left"):
        got = join_split(rows, side, "k", how, share=10)
        assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, rows.join(side, "k", how).select("k", "i", "v").collect()))
    assert join_split(rows.limit(0), side, ["k"]).collect() == []
