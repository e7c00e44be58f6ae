"""Language-model scores: prediction by partial matching over bytes, beside a unigram baseline over words.

The model is a trie of byte contexts up to ORDER bytes, counted over all training texts. A symbol is coded in the
longest context that was seen. If the context has it, with count c of n and q different symbols, it costs c / (n + q);
otherwise an escape, q / (n + q) (method C), leads to the context without its oldest byte, where the symbols of the
longer one are excluded: they could not be meant. What a context has seen, its shorter ones have seen, so exclusion only ever
concerns one step, and each context keeps what is left of its shorter one after exclusion. Below the empty context, the
unseen bytes are equally likely. A byte that UTF-8 never has ends a text, another one stands before its beginning.

The trie is a set of tables, one per order, keyed by context; a row is a node with its next symbols, 256 at most. Nothing of
it is left out and no more than a bounded part leaves the tables: the HOT_GRAMS most frequent grams (a context of ORDER bytes and
its symbol) go to the executors with their probabilities, and each text is scored there as far as they reach. The other grams of
a text are joined: with the grams of training, or, unseen, level by level with the nodes of their contexts.

The baseline needs a count for every word. The HOT most frequent words are scored where the text is; the others are joined with
the table of counts, so words and grams that fill the corpus are never shuffled by key and no vocabulary is broadcast. Neither bound changes a result.

A null text is empty: it has its end only. A null id is a training text. Rows with equal ids are scored one by one. Without training
texts, all bytes are equally likely. Columns besides id and text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import materialize
from lodestone.llm.simhash import LOWER
from lodestone.skew import join_split

ORDER = 5
BEFORE, END = 0xFE, 0xFF
#: Words and grams that go to the executors: the most frequent ones, at most so many.
HOT, HOT_GRAMS = 50_000, 1_000_000
#: Bytes of text at a time, and how many different words or grams a task gathers before it sends them on.
STRETCH, GATHERED = 500_000, 500_000


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def stretches(texts):
    """Lists of texts of about STRETCH bytes."""
    out, size = [], 0
    for t in texts:
        out.append(lowered(t.as_py()))
        size += len(out[-1])
        if size >= STRETCH:
            yield out
            out, size = [], 0
    if out:
        yield out


def windows(texts: Iterable[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, grams): for each symbol, ends included, its `order` bytes of context and itself. Long texts come in parts."""
    parts, owners, size = [], [], 0

    def keyed():
        data = np.frombuffer(b"".join(parts), np.uint8)
        key = np.zeros(max(0, len(data) - order), np.uint64)
        for j in range(order + 1):
            key <<= np.uint64(8)
            key |= data[j : j + len(key)].astype(np.uint64)
        lengths = np.array([len(p) for p in parts])
        # Windows that reach from one part into the next are no symbols.
        keep = np.ones(len(key), bool)
        keep[(np.cumsum(lengths)[:-1, None] - order + np.arange(order)).ravel()] = False
        return np.repeat(np.array(owners), lengths - order), key[keep]

    for i, t in enumerate(texts):
        data = bytes([BEFORE]) * order + t + bytes([END])
        for at in range(0, len(data) - order, STRETCH):
            parts.append(data[at : at + STRETCH + order])
            owners.append(i)
            size += len(parts[-1])
            if size >= STRETCH:
                yield keyed()
                parts, owners, size = [], [], 0
    if parts:
        yield keyed()


def gram_counts(df: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """(gram long, n long) over all texts of df."""

    def run(batches):
        keys, sums, size = [], [], 0

        def merged():
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(where, np.concatenate(sums)).astype(np.int64)

        def sent(k, n):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for _, found in windows((lowered(t.as_py()) for t in batch.column(0)), order):
                k, n = np.unique(found, return_counts=True)
                keys.append(k)
                sums.append(n)
                size += len(k)
                if size > 2 * GATHERED:
                    k, n = merged()
                    if len(k) > GATHERED:
                        yield sent(k, n)
                        keys, sums, size = [], [], 0
                    else:
                        keys, sums, size = [k], [n], len(k)
        if keys:
            yield sent(*merged())

    return df.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts of df; the words of the contract, without ends."""

    def sent(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for texts in stretches(batch.column(0)):
                for t in texts:
                    counts.update(t.split())
                if len(counts) > GATHERED // 2:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    return df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Table:
    """Finds the rows of 64-bit keys: a hash table of two or more places per key with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._home(keys)
        rows = self.slots[at]
        todo = np.flatnonzero((rows >= 0) & (self.keys[rows] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            rows[todo] = self.slots[at[todo]]
            todo = todo[(rows[todo] >= 0) & (self.keys[rows[todo]] != keys[todo])]
        return rows


def low_bytes(column: Column, n: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * n) - 1))


def context(gram: Column, k: int) -> Column:
    """The k bytes before the gram's symbol."""
    return low_bytes(F.shiftright(gram, 8), k)


def seen_probabilities(counts: DataFrame) -> DataFrame:
    """(gram, n, p): the log10 probability of each gram of training in its longest context, which has at most 256."""
    around = W.partitionBy(F.shiftright("gram", 8))
    return counts.select("gram", "n", (F.log10("n") - F.log10(F.sum("n").over(around) + F.count("*").over(around))).alias("p"))


def trie(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """The nodes of each order from 0: ctx, next (symbol to count), total, kinds, and what exclusion leaves of the shorter context:
    left (log10 of counts and different symbols) and left_escape."""
    out: list[DataFrame] = []
    for k in range(order + 1):
        grams = counts if k == order else counts.groupBy(low_bytes(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n"))
        entry = F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
        nodes = grams.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.map_from_entries(F.collect_list(entry)).alias("next"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if k:
            up = out[-1].select(F.col("ctx").alias("up"), F.col("next").alias("up_next"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
            nodes = nodes.join(up, low_bytes(F.col("ctx"), k - 1) == F.col("up"))
            shared = F.aggregate(F.map_keys("next"), F.lit(0).cast("long"), lambda a, s: a + F.element_at("up_next", s))
            other = F.col("up_kinds") - F.col("kinds")
            nodes = nodes.withColumn("rest", F.col("up_total") - shared + other)
            left, escape = F.log10("rest"), F.log10(other) - F.log10("rest")
            nodes = nodes.select("ctx", "next", "total", "kinds", *[F.when(F.col("rest") > 0, x).otherwise(0.0).alias(n) for x, n in ((left, "left"), (escape, "left_escape"))])
        else:
            nodes = nodes.select("*", F.lit(0.0).alias("left"), F.lit(0.0).alias("left_escape"))
        out.append(materialize(nodes, "nodes"))
    return out


def unseen_probabilities(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(gram, p) of different grams that training lacks; nodes: trie(). Each order is one join of the grams that are not done.

    Orders 0 and 1 have 257 nodes at most, which are broadcast. At the two longest orders a context has at most 65,536 different grams; in between a few
    contexts may have most of them, whose grams meet their nodes where they are.
    """
    order = len(nodes) - 1
    zero = F.lit(0.0)
    rows, settled = grams.select("gram", zero.alias("p"), F.lit(False).alias("inside"), zero.alias("up_left"), zero.alias("up_escape")), []
    for k in range(order, -1, -1):
        node = nodes[k].select(F.col("ctx").alias("key"), "next", "total", "kinds", "left", "left_escape")
        rows = rows.withColumn("key", context(F.col("gram"), k))
        if k < 2:
            rows = rows.join(F.broadcast(node), "key", "left")
        elif order - k < 2:
            rows = rows.join(node, "key", "left")
        else:
            rows = join_split(rows, node, "key", "left")
        n, known, inside = F.element_at("next", F.col("gram").bitwiseAND(F.lit(255)).cast("int")), F.col("total").isNotNull(), F.col("inside")
        size = F.log10(F.col("total") + F.col("kinds"))
        step = F.when(n.isNotNull(), F.log10(n) - F.when(inside, F.col("up_left")).otherwise(size))
        step = step.when(inside, F.col("up_escape")).when(known, F.log10("kinds") - size).otherwise(zero)
        rows = materialize(
            rows.select(
                "gram", (F.col("p") + step).alias("p"), n.isNotNull().alias("done"), (inside | known).alias("inside"),
                F.when(known, F.col("left")).otherwise(F.col("up_left")).alias("up_left"), F.when(known, F.col("left_escape")).otherwise(F.col("up_escape")).alias("up_escape"),
            ),
            "unseen",
        )
        settled.append(rows.where("done").select("gram", "p"))
        rows = rows.where("NOT done").drop("done")
    root = nodes[0].select("kinds").first()
    never = rows.select("gram", (F.col("p") - float(np.log10(max(1, 256 - (root[0] if root else 0))))).alias("p"))
    return functools.reduce(DataFrame.unionByName, settled, never)


def probabilities(grams: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) for different grams: the log10 probability of each gram's symbol after its context."""
    seen = seen_probabilities(counts).select("gram", "p")
    unseen = grams.join(counts.select("gram"), "gram", "left_anti")
    return grams.join(seen, "gram").select("gram", "p").unionByName(unseen_probabilities(unseen, trie(counts, order)))


def most_frequent(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and probabilities of whole classes of like counts, from the highest on, while they are `most` grams together."""
    size = F.floor(F.log2("n") * 8)
    kept, least = 0, None
    for r in seen.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # a few hundred rows, whatever the corpus
        kept += r["count"]
        if kept > most:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    found = seen.where(size >= least).select("gram", "p").toArrow()
    grams, p = (np.concatenate([np.asarray(c) for c in found.column(x).chunks] or [np.zeros(0)]) for x in ("gram", "p"))
    return grams.astype(np.int64).view(np.uint64), p


_tables: dict[str, Table] = {}


def table_of(name: str, keys: np.ndarray) -> Table:
    """The hash table of the frequent grams, built once in a worker."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Table(keys)
    return _tables[name]


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """One row per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    training = docs.where(~held_out(F.col("_id")))
    words = materialize(word_counts(training, "_text"), "words")
    sums = words.agg(F.sum("c"), F.count("*")).first()
    ends = training.count()
    total, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    scale = float(np.log10(total + 0.5 * (kinds + 1)))
    of = lambda c: float(np.log10(c + 0.5)) - scale
    often = {bytes(r["word"]): of(r["c"]) for r in words.orderBy(F.desc("c"), "word").limit(hot).collect()}
    counts = materialize(gram_counts(training, "_text", order), "grams")
    seen = materialize(seen_probabilities(counts), "seen")
    name = uuid.uuid4().hex
    given = spark.sparkContext.broadcast((*most_frequent(seen, hot_grams), often, of(ends), ends > 0))

    names = ["_id", "_key", "n_tokens", "n_known", "base_score", "score", "_rare", "_grams"]
    pair = lambda n, kind: T.ArrayType(T.StructType([T.StructField(n, kind), T.StructField("times", T.LongType())]))
    schema = T.StructType([
        docs.schema[0], *[T.StructField(n, T.LongType()) for n in names[1:4]], *[T.StructField(n, T.DoubleType()) for n in names[4:6]],
        T.StructField("_rare", pair("word", T.BinaryType())), T.StructField("_grams", pair("gram", T.LongType())),
    ])

    def of_grams(texts, table, p):
        """Per text the sum over frequent grams; and the others: bounds, grams, how often."""
        sums = np.zeros(len(texts))
        own, rest, times = [], [], []
        for owner, keys in windows(texts, order):
            rows = table.find(keys)
            found = rows >= 0
            sums += np.bincount(owner[found], p[rows[found]], len(texts))
            # Per text, different grams.
            different, place = np.unique(keys[~found], return_inverse=True)
            cell, n = np.unique(owner[~found] * max(1, len(different)) + place, return_counts=True)
            own.append(cell // max(1, len(different)))
            rest.append(different[cell % max(1, len(different))])
            times.append(n)
        own, rest, times = (np.concatenate(x) for x in (own, rest, times))
        return sums, np.searchsorted(own, np.arange(len(texts) + 1)), rest.view(np.int64), times

    def run(batches):
        grams, p, log_often, log_end, end_known = given.value
        table = table_of(name, grams)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            first = 0
            for texts in stretches(batch.column(1)):
                n_tokens, n_known, base, sizes, rare, times = [], [], [], [0], [], []
                for t in texts:
                    split = t.split()
                    known, s, before = int(end_known), log_end, len(rare)
                    for word, n in Counter(split).items():
                        log = log_often.get(word)
                        if log is None:
                            rare.append(word)
                            times.append(n)
                        else:
                            known += n
                            s += n * log
                    n_tokens.append(len(split) + 1)
                    n_known.append(known)
                    base.append(s)
                    sizes.append(sizes[-1] + len(rare) - before)
                scores, bounds, rest, often_ = of_grams(texts, table, p)
                pairs = lambda k, v, n: pa.StructArray.from_arrays([k, pa.array(v, pa.int64())], names=[n, "times"])
                columns = [
                    batch.column(0).slice(first, len(texts)), pa.array(np.arange(key, key + len(texts))), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(scores), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs(pa.array(rare, pa.binary()), times, "word")),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs(pa.array(rest, pa.int64()), often_, "gram")),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first += len(texts)
                key += len(texts)

    rows = materialize(docs.mapInArrow(run, schema), "scores")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - scale
    rest = (
        rows.select("_key", F.inline("_rare")).join(words, "word", "left")
        .select("_key", (F.col("times") * log_c).alias("more"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("also"), F.lit(0.0).alias("further"))
    )
    asked = rows.select("_key", F.inline("_grams"))
    wanted = materialize(asked.select("gram").distinct().join(seen.select("gram", "p"), "gram", "left"), "wanted")
    unseen = unseen_probabilities(wanted.where("p IS NULL").select("gram"), trie(counts, order))
    p_of = wanted.where("p IS NOT NULL").unionByName(unseen)
    rest = rest.unionByName(asked.join(p_of, "gram").select("_key", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("times") * F.col("p")).alias("further")))
    rest = rest.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("more", "also", "further")])
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.drop("_rare", "_grams").join(rest, "_key", "left").select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "n_tokens", plus("n_known", "also").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base_score", "more").alias("base_score"), plus("score", "further").alias("score"),
    )
