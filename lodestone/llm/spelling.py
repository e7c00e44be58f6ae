"""Spelling variants: words one edit apart by pivotal grams, and the more frequent form of each.

Two words one edit apart differ in one inserted, deleted or replaced code point. The bigrams of a word are ordered by
their number in the vocabulary, rarest first, equal ones by place; the prefix of a word are its first three, two of which
are disjoint. The two disjoint ones of least total number, found by dynamic programming, are its pivots. An edit leaves
one pivot of each word whole, and does not change the order of the bigrams that it leaves, so such a pivot of one word is
in the prefix of the other one, or the other way round. Pivots are looked up in prefixes, with the limit on positions in
its strictest form: what lies on the far side of the pivot from the edit is equal, so the lookup is one equi-join. With
pivots at i < j:

    edit behind j+1             equal up to the end of the second pivot
    edit from i+2 to j+1        equal up to the end of the first pivot, and behind the second
    edit at i or i+1            equal before the first pivot, and from the second on
    edit before i               equal from the first pivot on

In words of over LONG code points the middle cases are looked up by one side only, so that a word has a bounded number of
keys. Pairs are verified on the words. A word has at most two near words per place and letter, so no group of
pairs grows with the corpus.

Results that are defined: a null or empty text has no words; a null id counts as an empty one; rows that are equal count
each by itself. Columns besides id and text play no part. No rows give no words.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: What a run of letters is, the divisor of hashes that lose a letter, the least length and number of a word.
RUN, DIVISOR, LEAST_LENGTH, LEAST_COUNT = re.compile("[A-Za-zÀ-ÿ]+"), 97, 5, 3
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Different words that a task counts before it sends them on.
COUNTED = 200_000
#: Letters up to which a table of words goes to all tasks. Larger ones are merged: by its written size Spark takes a table for far smaller than it is in memory.
FEW = 1 << 20
LONG = 64


def variant(row_id, run: str) -> str:
    """The run, or for one (row, run) in so many the run without one of its letters."""
    h = zlib.crc32(f"{'' if row_id is None else row_id}:{run}".encode())
    if h % DIVISOR:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts. Tasks count before they send."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))

    def sent(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for row_id, body in zip(batch.column("id"), batch.column("text"), strict=True):
                for word, n in Counter(RUN.findall((body.as_py() or "").translate(LOWER))).items():
                    word = variant(row_id.as_py(), word)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield sent(counts)
                    counts = Counter()
        if counts:
            yield sent(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_numbers(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the words. The alphabet has 90 letters, so there are at most 8100."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(map("".join, zip(word, word[1:], strict=False)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def prefix(word: str, numbers: dict[str, int]) -> list[int]:
    """The places of the word's three rarest bigrams, of equal ones the leftmost."""
    return sorted(i for _, _, i in heapq.nsmallest(3, ((numbers[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))))


def pivots(word: str, places: list[int], numbers: dict[str, int]) -> tuple[int, int]:
    """The two disjoint bigrams of the prefix with the least total number: the best single one that ends before each place, carried along."""
    best, single, at = None, None, 0
    for j in places:
        while places[at] + 2 <= j:
            cost = (numbers[word[places[at] : places[at] + 2]], places[at])
            single = cost if single is None else min(single, cost)
            at += 1
        if single:
            both = (single[0] + numbers[word[j : j + 2]], single[1], j)
            best = both if best is None else min(best, both)
    return best[1], best[2]


def _key(case: int, head: str, tail: str, length: int) -> int:
    digest = xxhash.xxh64_intdigest(f"{case} {length} {len(head)} {head}{tail}".encode(), 0)
    return digest - (1 << 64) if digest >> 63 else digest


def pivot_keys(word: str, numbers: dict[str, int]) -> set[int]:
    """The keys by which a word looks for others, of its own length and one less or more."""
    i, j = pivots(word, prefix(word, numbers), numbers)
    out = set()
    for n in (len(word) - 1, len(word), len(word) + 1):
        out |= {_key(1, word[: j + 2], "", n), _key(3, "", word[i:], n)}
        if n <= LONG:
            out |= {_key(2, word[: i + 2], word[j + 2 :], n), _key(4, word[:i], word[j:], n)}
        else:
            out |= {_key(1, word[: i + 2], "", n), _key(3, "", word[j:], n)}
    return out


def prefix_keys(word: str, numbers: dict[str, int]) -> set[int]:
    """The keys under which a word is found."""
    n, out = len(word), set()
    for p in prefix(word, numbers):
        out |= {_key(1, word[: p + 2], "", n), _key(3, "", word[p:], n)}
        if n <= LONG:
            out |= {_key(2, word[: p + 2], word[k:], n) for k in range(p + 3, n + 1)}
            out |= {_key(4, word[:k], word[p:], n) for k in range(p)}
    return out


def _keyed(words: DataFrame, keys, numbers: dict[str, int]) -> DataFrame:
    """(key, word, n) for each key of each word."""

    def run(batches):
        for batch in batches:
            found = [list(keys(w, numbers)) for w in batch.column("word").to_pylist()]
            rows = pa.array([i for i, k in enumerate(found) for _ in k], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x for k in found for x in k], pa.int64()), batch.column("word").take(rows), batch.column("n").take(rows)], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def one_edit(x: str, y: str) -> str:
    """SQL: whether two different words are one edit apart; for long ones by the length of their common start, found by bisection."""
    mid = "CAST((a.lo + a.hi + 1) DIV 2 AS INT)"
    start = f"""aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', least(length({x}), length({y}))), (a, i) -> CASE
        WHEN a.lo >= a.hi THEN a WHEN left({x}, {mid}) = left({y}, {mid}) THEN named_struct('lo', {mid}, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', {mid} - 1) END, a -> a.lo)"""
    rest = lambda w, other: f"substring({w}, same + IF(length({w}) >= length({other}), 2, 1))"
    long = f"exists(array({start}), same -> {rest(x, y)} = {rest(y, x)})"
    return f"CASE WHEN abs(length({x}) - length({y})) > 1 THEN false WHEN length({x}) <= {LONG} THEN levenshtein({x}, {y}, 1) = 1 ELSE {long} END"


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both ways, each pair of words one edit apart. words: word, n, of at least LEAST_LENGTH letters."""
    numbers = gram_numbers(words)
    a, b = _keyed(words, pivot_keys, numbers), _keyed(words, prefix_keys, numbers).select("key", F.col("word").alias("other"), F.col("n").alias("m"))
    # Spark takes the keys to be about as large as the words, and would send all of a small vocabulary's to every task by way of the driver.
    met = a.join(b.hint("merge"), "key").where((F.col("word") != F.col("other")) & F.expr(one_edit("word", "other")))
    first = F.col("word") < F.col("other")
    side = lambda yes, no, out: F.when(first, F.col(yes)).otherwise(F.col(no)).alias(out)
    pairs = met.select(side("word", "other", "x"), side("n", "m", "nx"), side("other", "word", "y"), side("m", "n", "ny")).distinct()
    both = F.array(F.struct(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("near"), F.col("ny").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("ny").alias("n"), F.col("x").alias("near"), F.col("nx").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the end of the way along forms, none of which is a circle.

    Words whose form has a root get it, round by round. Numbers at least double along a way, so there are few rounds.
    """
    last = materialize(forms.where("form IS NULL").select("word", F.col("word").alias("root")), "roots")
    out, rest = last, forms.where("form IS NOT NULL").select("word", "form")
    letters = lambda: last.agg(F.sum(F.length("word") + F.length("root"))).first()[0]
    size = letters()
    while size:
        found = last.withColumnRenamed("word", "form")
        last = materialize(rest.join(F.broadcast(found) if size <= FEW else found.hint("merge"), "form").select("word", "root"), "roots")
        size = letters()
        out = out.unionByName(last) if size else out
    return out


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: int = 2) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. The form is the near word of largest n, if that is at least ratio * the word's n."""
    words = materialize(word_counts(df, id_col, text), "words")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    ok = -F.col("best.n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", F.when(ok, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, -F.col("best.n")).alias("form_n")), "forms")
    return rows.join(roots(rows).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")
