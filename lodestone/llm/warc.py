"""WARC records, and a Merkle audit of their fixity across replicas.

The audit hashes every record, builds a tree of hashes over the ordered offset ranges of each file and writes its levels. It compares the
replicas' roots, and reads only the children of nodes that differ, down to the records. Two intact replicas cost one
comparison of roots; a damaged one costs a path per damaged record.

Files hold a bounded number of records: a file number that more rows share is cut into parts by a hash, and equal
records of a file are one leaf with a number of copies, so no group grows with the corpus. The inner nodes of a file are
made where its leaves are, without further shuffles.

Null urls and bodies are empty. Ids may repeat or be null. Records that one replica alone has are reported as missing
or extra. An empty replica has no files: every file of the other one is reported. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.scratch import written, written_path

END = "\r\n\r\n"
FANOUT = 16
FILE_RECORDS = 1024
FILE = ("file", "part")
#: Parts in which a level is written.
BUCKETS = 32


def record(url: Column, body: Column) -> Column:
    """The record as text, with the two line ends that close it."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(body.cast("binary"), 256), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body, F.lit(END))


def write_warc(df: DataFrame, path: str, url: str = "url", body: str = "html", mode: str = "errorifexists") -> None:
    """One WARC file per partition of df."""
    whole = record(F.col(url), F.col(body))
    df.select(F.substring(whole, F.lit(1), F.length(whole) - len(END)).alias("value")).write.mode(mode).option("lineSep", END).text(path)


MARK = re.compile(rb"WARC/1\.[0-9]\r?\n")


def _record_at(data: bytes, start: int) -> tuple[int, str, bytes] | None:
    """(end, url, body) of the record at start, or None if it is damaged."""
    file = io.BytesIO(data)
    file.seek(start)
    if not MARK.fullmatch(file.readline()):
        return None
    fields: dict[bytes, bytes] = {}
    while (line := file.readline()).strip():
        name, colon, value = line.partition(b":")
        # A head that is cut off runs into the next one: a line without a name, or a field again.
        if not colon or not re.fullmatch(rb"[A-Za-z0-9-]+", name) or fields.setdefault(name.lower(), value) is not value:
            return None
    url, length = fields.get(b"warc-target-uri", b"").strip().decode("utf-8", "replace"), fields.get(b"content-length", b"").strip()
    length = int(length) if re.fullmatch(rb"[0-9]{1,18}", length) else None
    at = file.tell()
    # A damaged length leads elsewhere than to the end of a record.
    if length is None or data[at + length : at + length + len(END)] != END.encode():
        return None
    return at + length + len(END), url, data[at : at + length]


def parse_records(data: bytes) -> Iterator[tuple[int, int, str | None, bytes | None]]:
    """(start, end, url, body) of each record, in order; url and body are null for a damaged range.

    After damage, reading goes on where the next whole record begins; what lies between is one damaged range. A record whose url or
    body is changed, but not its length, is whole: the audit's hashes find it.
    """
    at = 0
    while at < len(data):
        found = _record_at(data, at)
        if found:
            yield at, found[0], found[1], found[2]
            at = found[0]
            continue
        next_ = next((m.start() for m in MARK.finditer(data, at + 1) if _record_at(data, m.start())), len(data))
        yield at, next_, None, None
        at = next_


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, start, end, url, html, damaged: every record under path, and every damaged range (url and html are null). A file is read by one task; writers keep files small."""
    kinds = {"path": pa.string(), "start": pa.int64(), "end": pa.int64(), "url": pa.string(), "html": pa.string(), "damaged": pa.bool_()}

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found = parse_records(content.as_py())
                while part := list(itertools.islice(found, 500)):
                    start, end, url, body = zip(*part, strict=True)
                    columns = [[name.as_py()] * len(part), start, end, url, [b if b is None else b.decode("utf-8", "replace") for b in body], [b is None for b in body]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, start long, end long, url string, html string, damaged boolean")


def leaves(df: DataFrame, file: Column, id_col: str = "page_id", url: str = "url", body: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """One row per different record: file, part, node (its place), id, hash, start, end."""
    text = record(F.col(url), F.col(body))
    rows = df.select(file.alias("file"), F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("hash"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.groupBy("file", "id", "hash", "size").agg(F.count("*").alias("copies"))
    large = rows.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > file_records).select("file", F.ceil(F.col("n") / file_records).cast("int").alias("parts"))
    # A null file is split like any other.
    rows = rows.alias("r").join(large.alias("l"), F.col("r.file").eqNullSafe(F.col("l.file")), "left").select("r.*", "parts").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "hash"), F.col("parts")).cast("int"), F.lit(0)))
    place = W.partitionBy(*FILE).orderBy("id", "hash")
    rows = rows.withColumn("node", (F.row_number().over(place) - 1).cast("long")).withColumn("end", F.sum(F.col("size") * F.col("copies")).over(place.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select(*FILE, "node", "id", F.sha2(F.concat_ws(":", "hash", "copies"), 256).alias("hash"), (F.col("end") - F.col("size") * F.col("copies")).alias("start"), "end")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each node hashes up to `fanout` children in order and spans their offsets."""
    up = F.floor(F.col("node") / fanout).cast("long")
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy(*FILE, up.alias("up")).agg(
        F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end")
    ).withColumnRenamed("up", "node")


class Level:
    """One level of a tree, written in BUCKETS parts by a hash of the file, so that a search reads the parts with differing files only."""

    def __init__(self, nodes: DataFrame, name: str):
        self.spark, self.path = nodes.sparkSession, written_path(nodes.sparkSession, name)
        placed = nodes.withColumn("bucket", F.pmod(F.xxhash64(*FILE), F.lit(BUCKETS)).cast("int"))
        placed.repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(self.path)
        self.schema = placed.schema
        self.nodes = self.spark.read.schema(self.schema).parquet(self.path)

    def parent(self, fanout: int) -> Level:
        return Level(parents(self.nodes, fanout), "level")

    def under(self, wanted: DataFrame, buckets: list[int], fanout: int) -> DataFrame:
        """The nodes whose parent is wanted, from the buckets named."""
        on = [F.col(f"n.{k}").eqNullSafe(F.col(f"w.{k}")) for k in FILE] + [F.floor(F.col("n.node") / fanout) == F.col("w.node")]
        return self.nodes.where(F.col("bucket").isin(buckets)).alias("n").join(wanted.alias("w"), on, "left_semi").drop("bucket")


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[Level]:
    """Leaves first, roots last; each level is made from the written one below it."""
    out = [Level(records, "leaves")]
    for _ in range(levels):
        out.append(out[-1].parent(fanout))
    return out


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not in both replicas with one hash."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*FILE, "node")]
    both = a.alias("a").join(b.alias("b"), on, "full_outer").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
    return both.select(*[F.when(F.col("a.hash").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in (*FILE, "node")])


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of the records under differing nodes, those that the replicas do not share; a record that only moved is no damage."""
    same = ["file", "id", "hash"]
    alone = lambda x, y: x.alias("x").join(y.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in same], "left_anti")
    nth = F.row_number().over(W.partitionBy("file", "id").orderBy("hash"))
    left, right = (alone(x, y).withColumn("nth", nth) for x, y in ((a, b), (b, a)))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("file", "id", "nth")]
    problem = F.when(F.col("a.hash").isNull(), "extra").when(F.col("b.hash").isNull(), "missing").otherwise("changed")
    pick = lambda c: F.when(F.col("a.hash").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return left.alias("a").join(right.alias("b"), on, "full_outer").select(*[pick(c) for c in (*FILE, "node", "id", "start", "end")], problem.alias("problem"))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records of a (the master) and b that differ: file, part, node, id, start, end, problem. a, b: leaves().

    Roots are compared first; below, only the children of differing nodes are read.
    """
    trees = [tree(x, 0, fanout) for x in (a, b)]
    most = max(t[0].nodes.agg(F.max("node")).first()[0] or 0 for t in trees)
    levels = 1
    while fanout**levels <= most:
        levels += 1
    for t in trees:
        for _ in range(levels):
            t.append(t[-1].parent(fanout))
    below = [t[levels].nodes.drop("bucket") for t in trees]
    for level in range(levels - 1, -1, -1):
        found = written(_different(*below), "differing")
        buckets = [r[0] for r in found.select(F.pmod(F.xxhash64(*FILE), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        below = [t[level].under(found, buckets, fanout) for t in trees]
    return reconcile(*below)
