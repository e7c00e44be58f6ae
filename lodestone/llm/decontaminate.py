"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared lower-cased, with white space runs as one space. A benchmark item is cut into segments; a segment is
found in a document where it can be turned into a stretch of the document with at most RATE edits per character.

* Lemma: a segment of n characters and a stretch within e edits share at least n - q + 1 - q * e character q-grams, and
  all of these lie on diagonals (document position less segment position) that are at most e apart.
* Filter: shared q-grams are counted per segment and per band of 2(e + 1) diagonals; bands overlap by half, so some
  band holds all q-grams of a true stretch. Only bands with enough of them are kept.
* Verification: a banded alignment, for many regions at a time, gives the least number of edits.

Work per document is one pass over its q-grams and needs no shuffle. The segments go to the executors in blocks of at
most BLOCK_CHARS characters, one pass over the documents per block, so what is broadcast has a fixed bound.

Null and empty texts match nothing, as do items shorter than q characters after normalization. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Q, RATE, SEGMENT = 8, 0.1, 120
BLOCK_CHARS = 2_000_000
#: Characters of text that are searched at a time.
PIECE_CHARS = 2_000_000
#: Pairs of equal q-grams that are counted at a time: text with more is searched in halves.
POSTINGS = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITMAP_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def q_grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q code points from each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = (codes.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    out = c[:n].copy()
    for j in range(1, q):
        out *= MULTIPLIER
        out += c[j : j + n]
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def cut(text: str, size: int = SEGMENT) -> list[tuple[int, str]]:
    """Segments of about `size` characters at half overlaps that cover the text; shorter texts are one segment."""
    if len(text) <= size * 3 // 2:
        return [(0, text)]
    n = math.ceil((len(text) - size) / (size // 2))
    return [(s, text[s : s + size]) for s in sorted({round(i * (len(text) - size) / n) for i in range(n + 1)})]


@dataclass
class Index:
    """The segments' q-grams: sorted hashes with their segments and positions."""

    items: list
    offsets: list[int]
    segments: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    width: int
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = RATE, size: int = SEGMENT) -> Index | None:
    found = [(i, at, s) for i, text in items for at, s in cut(normal(text), size) if len(s) >= q]
    if not found:
        return None
    segments = [code_points(s) for _, _, s in found]
    lengths = np.array([len(s) for s in segments])
    # Beyond (n - q) / q edits the lemma asks for no shared q-gram.
    edits = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
    grams = [q_grams(s, q) for s in segments]
    hashes = np.concatenate(grams)
    owner = np.repeat(np.arange(len(segments)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(hashes, kind="stable")
    hashes, first = np.unique(hashes[order], return_index=True)
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[slots(hashes)] = True
    return Index(
        [i for i, _, _ in found], [a for _, a, _ in found], segments, edits, lengths - q + 1 - q * edits, int(edits.max()) + 1,
        hashes, np.append(first, len(order)), owner[order], place[order], bitmap,
    )


def align(patterns: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the least number of edits between the pattern and a stretch of its region, and where the stretch ends.

    patterns: rows by most characters (0 after the end); regions: rows by most characters + band. In row i of the
    alignment, only the columns i to i + band of the region count.
    """
    rows, most = patterns.shape
    band = regions.shape[1] - most
    columns = np.arange(band + 1, dtype=np.int32)
    now = np.zeros((rows, band + 1), np.int32)
    best, end = np.full(rows, np.iinfo(np.int32).max, np.int32), np.zeros(rows, np.int64)
    for i in range(1, most + 1):
        cost = (patterns[:, i - 1, None] != regions[:, i - 1 : i + band]).astype(np.int32)
        step = now + cost  # the region's next character stands for the pattern's
        step[:, :band] = np.minimum(step[:, :band], now[:, 1:] + 1)  # the pattern's character is missing
        now = np.minimum.accumulate(step - columns, axis=1) + columns  # the region's character is extra
        last = np.flatnonzero(lengths == i)
        if len(last):
            best[last] = now[last].min(axis=1)
            end[last] = i + now[last].argmin(axis=1)
    return best, end


def search(texts: list[str], index: Index, q: int = Q) -> Iterator[tuple]:
    """(number of the text, item, segment's place in the item, edits, start, end) for each segment and stretch that fit."""
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    codes = code_points("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
    hashes = q_grams(codes, q)
    if not len(hashes):
        return
    hits = np.flatnonzero(index.bitmap[slots(hashes)])
    where = np.searchsorted(index.hashes, hashes[hits])
    where[where == len(index.hashes)] = 0
    real = index.hashes[where] == hashes[hits]
    hits, where = hits[real], where[real]
    counts = index.first[where + 1] - index.first[where]
    total = int(counts.sum())
    if not total:
        return
    if total > POSTINGS and (len(texts) > 1 or len(texts[0]) > 16 * SEGMENT):
        yield from _halves(texts, index, q)
        return
    # Every posting of every hit.
    postings = np.repeat(index.first[where] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    places = np.repeat(hits, counts)
    owner = index.owner[postings]
    diagonal = places - index.place[postings] + (1 << 20)
    doc = np.searchsorted(bounds, places, side="right") - 1
    cell = diagonal // index.width
    n_cells = int(cell.max()) + 2
    key = (doc * len(index.segments) + owner) * n_cells + cell
    keys, n = np.unique(key, return_counts=True)
    after = np.zeros(len(keys), np.int64)
    follows = np.flatnonzero(np.diff(keys) == 1)
    after[follows] = n[follows + 1]
    before = np.zeros(len(keys), np.int64)
    before[follows + 1] = n[follows]
    segment = keys // n_cells % len(index.segments)
    # A band is a cell and the next one; a cell alone may end one.
    keep = np.maximum(n + after, n + before) >= index.least[segment]
    keys, segment = keys[keep], segment[keep]
    if not len(keys):
        return
    doc, cell = keys // n_cells // len(index.segments), keys % n_cells
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in range(0, len(keys), 4096):
        part = slice(s, s + 4096)
        seg = segment[part]
        lengths = np.array([len(index.segments[x]) for x in seg])
        most, slack = int(lengths.max()), int(index.edits.max())
        patterns = np.zeros((len(seg), most), np.uint32)
        for r, x in enumerate(seg):
            patterns[r, : lengths[r]] = index.segments[x]
        begin = cell[part] * index.width - (1 << 20) - index.width - slack
        band = 3 * index.width + 2 * slack
        at = begin[:, None] + np.arange(most + band)
        d = doc[part]
        inside = (at >= bounds[d][:, None]) & (at < bounds[d + 1][:, None] - 1)
        regions = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
        edits, end = align(patterns, lengths, regions)
        for r in np.flatnonzero(edits <= index.edits[seg]):
            stop = int(begin[r] + end[r] - bounds[d[r]])
            it = (int(d[r]), int(seg[r]))
            if it not in found or (int(edits[r]), stop) < found[it][:2]:
                found[it] = (int(edits[r]), stop, int(lengths[r]))
    for (d0, s0), (e0, stop, length) in sorted(found.items()):
        yield d0, index.items[s0], index.offsets[s0], e0, max(0, stop - length), stop


def _halves(texts: list[str], index: Index, q: int) -> Iterator[tuple]:
    """search() in two parts: of the texts, or of the only text, whose halves overlap by more than any stretch."""
    if len(texts) > 1:
        half = len(texts) // 2
        yield from search(texts[:half], index, q)
        for n, *rest in search(texts[half:], index, q):
            yield n + half, *rest
        return
    half = len(texts[0]) // 2
    best: dict[tuple, tuple] = {}
    for at, part in ((0, texts[0][: half + 4 * SEGMENT]), (half, texts[0][half:])):
        for _, item, segment, edits, start, end in search([part], index, q):
            if (item, segment) not in best or (edits, at + end) < (best[item, segment][0], best[item, segment][2]):
                best[item, segment] = (edits, at + start, at + end)
    for (item, segment), found in sorted(best.items()):
        yield 0, item, segment, *found


def blocks_of(benchmark: DataFrame, id_col: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_chars characters each."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_chars)) if total > block_chars else 1
    for b in range(n):
        yield [(r["id"], r["t"]) for r in items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == b).collect()]


def pieces(batch: pa.RecordBatch, column: str | int, most: int = PIECE_CHARS, overlap: int = 4 * SEGMENT) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of about `most` characters of (row, place in its normal text, normal text). Longer texts come in overlapping slices."""
    size, out = 0, []
    for row, value in enumerate(batch.column(column)):
        text = normal(value.as_py())
        for at in range(0, max(1, len(text) - overlap), most):
            out.append((row, at, text[at : at + most + overlap]))
            size += len(out[-1][2])
            if size >= most:
                yield out
                size, out = 0, []
    if out:
        yield out


def search_rows(batch: pa.RecordBatch, column: str | int, index: Index | None) -> list[tuple]:
    """What search() finds, by row of the batch; of a text in slices, the stretch with the fewest edits."""
    found: dict[tuple, tuple] = {}
    for piece in pieces(batch, column) if index else ():
        for n, item, segment, edits, start, end in search([t for _, _, t in piece], index):
            row, at, _ = piece[n]
            best = found.get((row, item, segment))
            if best is None or (edits, at + end) < (best[3], best[5]):
                found[row, item, segment] = (row, item, segment, edits, at + start, at + end)
    return list(found.values())


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, rate: float = RATE) -> DataFrame:
    """One row per document and segment found: id, item_id, segment_start, edits, and the stretch of the normal text.

    The stretch with the fewest edits is reported; `start` assumes that it is as long as the segment.
    """
    rows = df.select(F.col(id_col), F.col(text).alias("_text"))
    places = [T.StructField(n, T.LongType()) for n in ("segment_start", "edits", "start", "end")]
    schema = T.StructType([rows.schema[0], T.StructField("item_id", benchmark.schema[item_id].dataType), *places])
    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    out = None
    for items in blocks_of(benchmark, item_id, item_text, block_chars):
        index = df.sparkSession.sparkContext.broadcast(build_index(items, rate=rate))

        def run(batches, index=index):
            for batch in batches:
                found = search_rows(batch, batch.num_columns - 1, index.value)
                if found:
                    ids = batch.column(0).take(pa.array([f[0] for f in found]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(types, 1))], names=schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document and item: how many of the item's segments were found, and the edits of the best one."""
    found = matches(df, benchmark, id_col, text, **options)
    return found.groupBy(id_col, "item_id").agg(F.count_distinct("segment_start").alias("n_segments"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))


def clean_rows(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, rate: float = RATE) -> DataFrame:
    """The rows of df in which no segment is found, with all columns."""
    for items in blocks_of(benchmark, item_id, item_text, block_chars):
        index = df.sparkSession.sparkContext.broadcast(build_index(items, rate=rate))

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in search_rows(batch, text, index.value)]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
