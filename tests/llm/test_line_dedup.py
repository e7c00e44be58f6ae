import random

from lodestone.llm import line_dedup, queries
from tests.llm import brute


def check(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute.dedup_lines(docs)
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        gone = want.get(r.doc_id, set())
        assert set(r.removed_lines) == gone, (r.doc_id, r.removed_lines, gone)
        text = docs[r.doc_id]
        assert r.text == (text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return want


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(100)) for _ in range(n))


def test_planted_runs(spark):
    rng = random.Random(1)
    one, several = words(rng, 60), "\n".join(words(rng, n) for n in (12, 30, 3, 20, 8))
    tail = words(rng, 300) + "\n" + words(rng, 20) + "\n" + words(rng, 25)
    short = words(rng, 30)
    docs = {
        1: one + "\n" + words(rng, 20), 2: words(rng, 40) + "\n" + several + "\n\n" + words(rng, 9), 3: words(rng, 10) + "\n" + one,
        4: words(rng, 5) + "\n" + several + "\nend", 5: several, 6: tail, 7: "x\n" + tail + "\ny", 8: short + "\na", 9: short + "\nb",
        10: "\n".join([words(rng, 4)] * 60), 11: None, 12: "", 13: "\n\n", 14: words(rng, 9) + "\n" + words(rng, 5000),
    }
    want = check(spark, docs)
    assert want[3] == {1} and want[5] == set(range(5)) and want[4] == {1, 2, 3, 4, 5} and want[7] == {1, 2, 3}
    assert 8 not in want and 9 not in want and 1 not in want and want[10] == set(range(1, 60))


def test_random_documents(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.choice((1, 2, 8, 15, 26, 55))) for _ in range(25)] + ["", " "]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 8))] for _ in range(8)]
    docs = {}
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(pool)]
        docs[d] = "\n".join(lines)
    check(spark, docs)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    text = words(rng, 70)
    rows = [(1, text, "x"), (1, text, "y"), (None, text, "n"), (2, "pre\n" + text, None), (2, "other\n" + text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_lines string").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "removed_lines"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", ""), ("1", ""), ("2", "other"), ("2", "pre"), ("None", text)]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute.dedup_lines(docs)
    rows = queries.op8_line_dedup(spark, sf_dir).collect()
    assert {r.doc_id: {int(x) for x in r.removed_lines.split(",")} for r in rows if r.n_removed} == want


def removed(spark, docs):
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    return {r.doc_id: set(r.removed_lines) for r in rows if r.removed_lines}


def test_later_places_besides_the_first(spark):
    rng = random.Random(5)
    x, y = words(rng, 30), words(rng, 30)
    docs = {1: "\n".join((words(rng, 40), x, words(rng, 40))), 2: "\n".join((words(rng, 20), x, y)), 3: "\n".join((words(rng, 35), x, y))}
    assert removed(spark, docs) == brute.dedup_lines(docs) == {3: {1, 2}}


def test_all_earlier_places(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.choice((1, 3, 9, 18, 26, 30, 55))) for _ in range(9)] + [""]
    docs = {d: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for d in range(80)}
    want = brute.dedup_lines(docs)
    assert want and removed(spark, docs) == want


def test_clashing_names(spark):
    rng = random.Random(3)
    text = words(rng, 70)
    df = spark.createDataFrame([(1, text, "a", "b", "c"), (2, "x\n" + text, "a", "b", "c")], "doc_id long, text string, _d_id string, row string, _d_hash string")
    rows = line_dedup.dedup_lines(df).collect()
    assert {(r.doc_id, r.text, r._d_id, r.row, r._d_hash) for r in rows} == {(1, text, "a", "b", "c"), (2, "x", "a", "b", "c")}
