import hashlib

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import queries, warc

ROWS = [(i, f"http://x.org/{i}", f"<p>é {i}</p>\r\n\r\n" * (i % 4)) for i in range(300)] + [(300, None, None), (None, "http://null.id/", "n"), (7, "http://x.org/7", "other"), (8, "http://x.org/8", "<p>é 8</p>")]
SCHEMA = "page_id long, url string, html string"


def found(spark, a, b, **options):
    frames = [spark.createDataFrame(x, SCHEMA) for x in (a, b)]
    rows = warc.audit(*[warc.leaves(f, F.floor(F.col("page_id") / 128), **options) for f in frames]).collect()
    return sorted((r.id, r.problem) for r in rows)


def test_intact_replica(spark):
    assert found(spark, ROWS, ROWS[::-1]) == []
    assert found(spark, ROWS, ROWS, file_records=10) == []
    assert found(spark, [], []) == []


def test_damage_is_located(spark):
    b = [r for r in ROWS if r[0] not in (5, 200)] + [(999, "http://new/", "x")]
    b = [(i, u, h + "!" if i == 130 else h) for i, u, h in b]
    want = [(5, "missing"), (130, "changed"), (200, "missing"), (999, "extra")]
    assert found(spark, ROWS, b) == want
    assert found(spark, ROWS, b, file_records=10) == want
    assert found(spark, ROWS[:5], []) == [(i, "missing") for i in range(5)]


def test_copies_and_hot_files(spark):
    a = [(1, "u", "same")] * 500 + [(1, "u", f"{i}") for i in range(40)]
    assert found(spark, a, a[::-1], file_records=8) == []
    assert found(spark, a, a[1:], file_records=8) == [(1, "changed")]  # one copy fewer
    assert found(spark, a, a[:-1], file_records=8) == [(1, "missing")]


def test_tree_by_hand(spark):
    rows = warc.leaves(spark.createDataFrame(ROWS[:40], SCHEMA), F.lit(1)).orderBy("node").collect()
    assert [r.id for r in rows] == list(range(40)) and all(a.end == b.start for a, b in zip(rows, rows[1:]))
    level = [r.hash for r in rows]
    leaves = spark.createDataFrame(rows)
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        leaves = warc.parents(leaves, 4)
        assert [r.hash for r in leaves.orderBy("node").collect()] == level
    root = leaves.collect()[0]
    assert (root.start, root.end) == (0, rows[-1].end)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    warc.write_warc(df, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.url, r.html) for r in back) == sorted((u or "", h or "") for _, u, h in ROWS)
    for r in back:
        with open(r.path.removeprefix("file:"), "rb") as f:
            assert f.read()[r.start : r.end].startswith(b"WARC/1.0")
    assert not any(r.damaged for r in back)
    cut = b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"
    assert list(warc.parse_records(b"")) == [] and list(warc.parse_records(cut)) == [(0, len(cut), None, None)]


def made(url, body):
    return f"WARC/1.0\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def test_reading_goes_on_after_damage():
    records = [made(f"http://x/{i}", f"body {i} é\r\n\r\nWARC/1.0 is a format\r\n" * (i + 1)) for i in range(6)]
    whole = b"".join(records)
    starts = [len(b"".join(records[:i])) for i in range(7)]
    assert [r[:2] for r in warc.parse_records(whole)] == list(zip(starts, starts[1:]))
    for i in range(6):
        head = records[i]
        for bad in (head.replace(b"WARC/1.0\r", b"WARX/1.0\r", 1), head.replace(b"Content-Length: ", b"Content-Length: 9", 1), head.replace(b"Content-Length: ", b"Content-Length: x", 1), head[: len(head) // 2], head[:20], head[:35], b"noise\n" + head[30:]):
            data = b"".join([*records[:i], bad, *records[i + 1 :]])
            found = list(warc.parse_records(data))
            assert [r[2] for r in found if r[2] is not None] == [f"http://x/{k}" for k in range(6) if k != i]
            assert [(r[0], r[1]) for r in found if r[2] is None] == [(starts[i], starts[i] + len(bad))]
            assert all(a[1] == b[0] for a, b in zip(found, found[1:])) and (found[0][0], found[-1][1]) == (0, len(data))
    lost = list(warc.parse_records(records[0] + b"\0" * 50 + records[1] + b"\0" * 7))
    assert [r[2] for r in lost] == ["http://x/0", None, "http://x/1", None]


def test_damaged_files_in_a_table(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(made("http://a/", "one") + made("http://b/", "two")[:-20] + made("http://c/", ""))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.url, r.html, r.damaged) for r in rows] == [("http://a/", "one", False), (None, None, True), ("http://c/", "", False)]


def test_odd_tables(spark):
    assert found(spark, [], ROWS[:3]) == [(i, "extra") for i in range(3)]
    long = [(1, "http://long/", "é" * 3_000_000), (2, None, None)]
    assert found(spark, long, long) == [] and found(spark, long, [(1, "http://long/", "é" * 2_999_999 + "e"), long[1]]) == [(1, "changed")]
    names = ("file", "part", "node", "hash", "start", "end", "size", "copies", "n", "parts", "id")
    extra = spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("mine").alias(c) for c in names])
    plain = spark.createDataFrame(ROWS[1:], SCHEMA)
    rows = warc.audit(*[warc.leaves(f, F.floor(F.col("page_id") / 128)) for f in (extra, plain)]).collect()
    assert [(r.id, r.problem) for r in rows] == [(0, "missing")]


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_warc_fixity"]).fetchall()
    got = queries.op9_warc_fixity(spark, sf_dir)
    assert got.columns == ["page_id", "file", "start", "end", "problem"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_a_large_null_file_is_split(spark):
    df = spark.createDataFrame([(None, f"http://a/{i}", "x") for i in range(40)] + [(1, "http://b", "y")], "page_id long, url string, html string")
    rows = warc.leaves(df, F.floor(F.col("page_id") / 10).cast("long"), file_records=8).collect()
    assert len(rows) == 41 and len({r.part for r in rows if r.file is None}) > 1 and {r.part for r in rows if r.file == 0} == {0}
