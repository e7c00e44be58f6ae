import hashlib
import random
from collections import Counter

import pytest

from lodestone.operators import building, resolution
from lodestone.schemas import ENTITIES, EXTRACTION, Graph


def key(name):
    return "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def edits(a, b):
    now = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(now[j - 1] + (x != y), now[j] + 1, new[j - 1] + 1))
        now = new
    return now[-1]


def similarity(a, b):
    return 1.0 if not a and not b else 1 - edits(a, b) / max(len(a), len(b))


def resolve(entities, name, kind):
    """One mention after the other. entities: [name, type, aliases] in order."""
    for i, (n, t, aliases) in enumerate(entities):
        if t == kind:
            if key(n) == key(name):
                return i, "exact"
            if key(name) in map(key, aliases):
                return i, "alias"
    best = max(((similarity(name, n), -i) for i, (n, t, _) in enumerate(entities) if t == kind), default=(0, 0))
    return (-best[1], "similarity") if best[0] >= 0.95 else (None, "new")


def stream(mentions):
    entities, found = [], []
    for name, kind in mentions:
        i, via = resolve(entities, name, kind)
        if i is None:
            i = len(entities)
            entities.append([name, kind, []])
        elif name != entities[i][0] and name not in entities[i][2]:
            entities[i][2].append(name)
        found.append((entities[i][0], via))
    return entities, found


def noisy(rng, name):
    for _ in range(rng.choice((0, 0, 1, 1, 2))):
        i = rng.randrange(len(name) + 1)
        name = rng.choice((name[:i] + "x" + name[i:], name[:i] + name[i + 1 :], name[:i] + "y" + name[i + 1 :], name[:i] + "-" + name[i:]))
    return name


BASES = ["C", "C++", "C#", "東京", "大阪", "GPT-5", "Micro services architecture one", "MicroservicesArchitecture", "The quite long name of a company with many letters", "abcdefghijklmnopqrstuvwx", "Zürich"]


@pytest.mark.parametrize("seed", range(3))
def test_stream(spark, seed):
    rng = random.Random(seed)
    mentions = [(noisy(rng, rng.choice(BASES)), rng.choice(("Product", "Concept"))) for _ in range(120)]
    df = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(mentions)], "name string, type string, seq long").repartition(3)
    found, entities = resolution.resolve_stream(df)
    want, via = stream(mentions)
    names = {r.id: r for r in entities.collect()}
    assert sorted((r.canonical_name, r.entity_type, tuple(r.aliases)) for r in names.values()) == sorted((n, t, tuple(a)) for n, t, a in want)
    got = [(names[r.entity_id].canonical_name, r.matched_via) for r in found.orderBy("seq").collect()]
    assert got == via


def test_pairs_miss_nothing(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (19, 20, 21, 39, 40, 41, 62, 85)]
    names = list(dict.fromkeys([noisy(rng, noisy(rng, b)) for b in base for _ in range(12)]))
    df = spark.createDataFrame([(str(i), "t", n, i) for i, n in enumerate(names)], "rid string, type string, name string, seq long")
    got = {(int(r.later), int(r.earlier)) for r in resolution.similar_pairs(df).collect()}
    assert got == {(j, i) for j in range(len(names)) for i in range(j) if 20 * edits(names[i], names[j]) <= max(len(names[i]), len(names[j]))}


def test_against_a_graph(spark):
    graph = [("Pydantic", "Technology", []), ("GPT-5", "Product", ["OpenAI GPT-5"]), ("MicroservicesArchitecture", "Concept", []), ("Other", "Product", ["gpt 5"])]
    entities = spark.createDataFrame([(n, n, t, a, None, None, i) for i, (n, t, a) in enumerate(graph)], ENTITIES)
    asked = [("Pydanti", "Technology"), ("pydantic!", "Technology"), ("OpenAI GPT-5", "Product"), ("gpt5", "Product"), ("MicroservicesArchitectur", "Concept"), ("Pydantic", "Concept")]
    rows = resolution.resolve_against(entities, spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(asked)], "mid long, name string, type string")).orderBy("mid").collect()
    for r, (n, t) in zip(rows, asked):
        i, via = resolve(graph, n, t)
        assert (r.entity_id, r.matched_via, r.is_new) == (None if i is None else graph[i][0], via, via == "new")


def test_build(spark):
    answers = [
        ("a", [("FastAPI", "Technology"), ("Pydantic", "Technology")], [("FastAPI", "Pydantic", "USES", "s1", 0.9), ("FastAPI", "Nobody", "USES", "s2", 0.9)]),
        ("b", [("Fast API", "Technology"), ("Pydantic", "Technology"), ("Pydantic", "Concept")], [("Fast API", "Pydantic", "USES", "s3", 0.5), ("Fast API", "Fast API", "USES", "s4", 0.4), ("Fast API", "Fast API", "USES", "s4", 0.4)]),
        ("c", [("FastAPI", "Technology"), ("pydantic", "Technology")], [("FastAPI", "pydantic", "USES", "s5", 0.1)]),
        ("d", None, None),
    ]
    df = spark.createDataFrame(answers, f"chunk_id string, {EXTRACTION}")
    graph, mentions = building.build_graph(df)
    names = {r.id: r for r in graph.entities.collect()}
    assert sorted((r.canonical_name, r.entity_type, tuple(r.aliases)) for r in names.values()) == [("FastAPI", "Technology", ("Fast API",)), ("Pydantic", "Concept", ()), ("Pydantic", "Technology", ("pydantic",))]
    edges = {(names[r.source_entity_id].canonical_name, names[r.target_entity_id].canonical_name, names[r.target_entity_id].entity_type): r for r in graph.relationships.collect()}
    assert {k: r.confidence for k, r in edges.items()} == {("FastAPI", "Pydantic", "Technology"): 0.9, ("FastAPI", "Pydantic", "Concept"): 0.5, ("FastAPI", "FastAPI", "Technology"): 0.4}
    proof = {k: graph.evidence.where(f"relationship_id = '{r.id}'").count() for k, r in edges.items()}
    assert proof == {("FastAPI", "Pydantic", "Technology"): 2, ("FastAPI", "Pydantic", "Concept"): 1, ("FastAPI", "FastAPI", "Technology"): 2}
    assert mentions.count() == 7
    again, _ = building.build_graph(df.repartition(4))
    assert sorted(map(str, again.relationships.collect())) == sorted(map(str, graph.relationships.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_stream_into_known_entities(spark, seed):
    rng = random.Random(10 + seed)
    draw = lambda n: [(noisy(rng, rng.choice(BASES)), rng.choice(("Product", "Concept"))) for _ in range(n)]
    known, mentions = [[n, t, rng.choice(([], [noisy(rng, n)]))] for n, t in draw(14)], draw(120)
    rows = [(f"k{i}", n, t, a, None, None, i) for i, (n, t, a) in enumerate(known)]
    df = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(mentions)], "name string, type string, seq long").repartition(3)
    found, entities = resolution.resolve_into(spark.createDataFrame(rows, ENTITIES), df)
    entities = entities.orderBy("ord").collect()
    want = [[n, t, list(a)] for n, t, a in known]
    via = []
    for name, kind in mentions:
        i, how = resolve(want, name, kind)
        if i is None:
            i = len(want)
            want.append([name, kind, []])
        elif name != want[i][0] and name not in want[i][2]:
            want[i][2].append(name)
        via.append((i, how))
    assert [[r.canonical_name, r.entity_type, r.aliases] for r in entities] == want
    place = {r.id: i for i, r in enumerate(entities)}
    assert [(place[r.entity_id], r.matched_via) for r in found.orderBy("seq").collect()] == via


def test_many_names_with_one_start(spark):
    rng = random.Random(3)
    names = [f"Organization Number {i:05d}" for i in range(3000)] + ["Organization Number"]
    df = spark.createDataFrame([(str(i), "t", n, i) for i, n in enumerate(names)], "rid string, type string, name string, seq long").repartition(4)
    got = {(int(r.later), int(r.earlier)) for r in resolution.similar_pairs(df).collect()}
    sample = rng.sample(range(len(names)), 25)
    assert {p for p in got if p[0] in sample} == {(j, i) for j in sample for i in range(j) if 20 * edits(names[i], names[j]) <= max(len(names[i]), len(names[j]))}


def test_extending_is_building(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        names = list(dict.fromkeys((noisy(rng, rng.choice(BASES)), rng.choice(("Product", "Concept"))) for _ in range(5)))
        ends = [*(n for n, _ in names), "nobody"]
        rows.append((f"c{i:02}", names, [(rng.choice(ends), rng.choice(ends), rng.choice(("USES", "PART_OF")), "said", rng.random()) for _ in range(5)]) if i % 7 else (f"c{i:02}", None, None))
    df = spark.createDataFrame(rows, f"chunk_id string, {EXTRACTION}")
    whole, _ = building.build_graph(df)
    part, _ = building.build_graph(df.where("chunk_id < 'c15'"))
    graph = Graph(*(building.numbered(t) for t in (part.entities, part.relationships, part.evidence)))
    for a, b in (("c15", "c30"), ("c30", "c99"), ("c30", "c99")):  # the last one comes again
        graph, _ = building.extend_graph(graph, df.where(f"chunk_id >= '{a}' AND chunk_id < '{b}'"))
    for got, want in ((graph.entities, whole.entities), (graph.relationships, whole.relationships), (graph.evidence, whole.evidence)):
        assert [r.ord for r in got.orderBy("ord").collect()] == list(range(got.count()))
        rows = lambda t: [tuple(r) for r in t.orderBy("ord").select(*[c for c in want.columns if c != "ord"]).collect()]  # noqa: B023, E731
        assert rows(got) == rows(want)


def test_pieces_tell_many_names_apart(spark):
    names = [f"Buyer no {i} {hashlib.md5(str(i).encode()).hexdigest()[:16]}" for i in range(4000)]
    counts = resolution.gram_counts(spark.createDataFrame([(n,) for n in names], "name string"))
    met = Counter((n[p : p + letters], p) for n in names for p, letters in resolution.rare_pieces(n, counts))
    assert sum(met.values()) == 2 * len(names) and sum(k * k for k in met.values()) < 4 * len(names)
