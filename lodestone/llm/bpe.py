"""Byte-level BPE by recursive queries in DuckDB, one database per Spark task's worker.

The tokenizer's pattern cuts a text into pieces. For pieces that the worker has not met, rows of (piece, place, token)
start with single bytes; each round of a recursive query joins neighbours with the merge table, finds each piece's
minimum-rank pair and contracts it, leftmost first, until no pair is left. A round contracts all places of that pair
that do not overlap: no contraction of it makes an earlier one possible, so the result is that of one at a time. Decoding joins token ids with
the vocabulary in order of place; the bytes of the ordered rows, one after the other, are the text.

Long pieces are encoded in overlapping windows, as pieces of their own, so their rounds stay few. An encoding is right when each two neighbours
are right together, so two windows that hold the same token at the same place join there without a difference. Where they
hold none, the later window begins at a token of the earlier one instead, further back until both agree on it, at worst at the piece's beginning.

The merge table follows from the ranks: two tokens merge when their concatenation is a token, and its id is the rank. A null text is empty; it has no
tokens and decodes to nothing. Repeated rows are encoded one by one, an empty table gives an empty result, and extra columns of any
name pass through, but for those that the result replaces.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
from collections.abc import Iterable
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import unused
from lodestone.llm.fst_tokens import END, classes, piece_starts, stretches

#: Pieces whose tokens a worker keeps (and as many that it kept before), bytes of new ones that one query encodes, and tokens that one decodes.
KEPT, AT_ONCE, TOKENS = 500_000, 400_000, 500_000
#: Bytes of a window of a long piece, and from one to the next.
WINDOW, STEP = 96, 64
#: Characters that are encoded at a time.
TEXT_CHARS = 3_000_000

#: Rows of pieces without a pair stay behind as not live. `least` has a piece's best rank above 32 bits and its first place below; of
#: two equal tokens, whose pairs may overlap, a round contracts the first place alone.
ENCODE = """
WITH RECURSIVE enc(piece, place, id, live) AS (
  SELECT piece, place, id, true FROM start
  UNION ALL
  (
    WITH pairs AS MATERIALIZED (
      SELECT p.*, m.merged
      FROM (
        SELECT piece, place, id, CASE WHEN lead(piece) OVER w = piece THEN id * 65536::UINTEGER + lead(id) OVER w END AS pair, lead(place) OVER w AS next_place
        FROM enc WHERE live WINDOW w AS (ORDER BY place)
      ) p
      LEFT JOIN merges m USING (pair)
    ), least AS (
      SELECT piece, min(merged * 4294967296::BIGINT + place) AS least FROM pairs GROUP BY piece
    ), marked AS MATERIALIZED (
      SELECT piece, place, id, merged, next_place, least, merged = least >> 32 AND (pair >> 16 <> pair & 65535 OR place = least & 4294967295) AS now
      FROM pairs JOIN least USING (piece)
    )
    SELECT piece, place, CASE WHEN now THEN merged ELSE id END, least IS NOT NULL
    FROM marked WHERE place NOT IN (SELECT next_place FROM marked WHERE now)
  )
)
SELECT piece, id FROM enc WHERE NOT live ORDER BY place
"""

DECODE = "SELECT v.bytes FROM tokens t JOIN vocabulary v USING (id) ORDER BY t.place"


def split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces of all texts, the number of each piece in order, and where each text ends: a piece of its own that is no text."""
    joined = "\0".join(texts) + "\0"
    raw = joined.encode("utf-8", "replace")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[codes]
    kinds[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
    starts = np.append(piece_starts(kinds), len(kinds) - 1)  # the last end is a piece as well
    if len(raw) == len(codes):
        offsets = np.append(starts, len(raw))
    else:
        sizes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        sizes[(codes >= 0xD800) & (codes < 0xE000)] = 1  # halves of a pair are replaced
        offsets = np.append((np.cumsum(sizes) - sizes)[starts], len(raw))
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    return pieces.dictionary.to_pylist(), np.asarray(pieces.indices), np.flatnonzero(kinds[starts] == END)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Codec:
    """A DuckDB database with the vocabulary and the merge table, and the pieces encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        rows = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        # No folder to spill to: a query that does not fit in memory is an error, not a file on the machine.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        merges = np.array(rows, np.int64).reshape(-1, 3)
        self._create("merges", {"pair": (merges[:, 0] * 65536 + merges[:, 1]).astype(np.uint32), "merged": merges[:, 2].astype(np.uint32)})
        self._create("vocabulary", {"id": np.array(list(ranks.values()), np.uint32), "bytes": pa.array(list(ranks), pa.binary())})
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _create(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _run(self, name: str, columns: dict, query: str) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Encodes the pieces that are new. Of pieces that were not met for long, the worker forgets the tokens."""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        new = set(pieces).difference(self.known)
        again = [p for p in new if p in self.older]
        self.known.update((p, self.older[p]) for p in again)
        new.difference_update(again)
        short = [p for p in new if len(p) <= WINDOW]
        self.known.update(zip(short, self.tokens(short), strict=True))
        self.known.update((p, np.array(self.long_tokens(p), "<u4").tobytes()) for p in new if len(p) > WINDOW)

    def tokens(self, raws: list[bytes]) -> list[bytes]:
        """The packed tokens of each piece, none of which is empty."""
        out = []
        sizes = np.array([len(r) for r in raws], np.int64)
        query = (np.cumsum(sizes) - sizes) // AT_ONCE
        for q in np.unique(query):
            s, e = np.searchsorted(query, [q, q + 1])
            data = np.frombuffer(b"".join(raws[s:e]), np.uint8)
            start = {"piece": np.repeat(np.arange(e - s, dtype=np.int32), sizes[s:e]), "place": np.arange(len(data), dtype=np.int32), "id": self.byte_ids[data]}
            found = self._run("start", start, ENCODE)
            ids = np.asarray(found.column("id")).astype("<u4").tobytes()
            bounds = (4 * np.flatnonzero(np.diff(np.asarray(found.column("piece")), prepend=-1, append=-1))).tolist()
            out += [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def long_tokens(self, raw: bytes) -> list[int]:
        """The tokens of a piece of any length, from windows that overlap."""
        begins = list(range(0, max(1, len(raw) - (WINDOW - STEP)), STEP))
        windows = list({raw[i : i + WINDOW] for i in begins})
        known = dict(zip(windows, map(unpacked, self.tokens(windows)), strict=True))

        def window(a: int, b: int) -> list[int]:
            part = raw[a:b]
            if part not in known:
                known[part] = unpacked(self.tokens([part])[0])
            return known[part]

        def places(first: int, ids: list[int]) -> list[int]:
            return (first + np.cumsum([0, *self.sizes[ids[:-1]]])).tolist()

        out = list(window(0, WINDOW))
        at = places(0, out)
        for begin in begins[1:]:
            ids = window(begin, begin + WINDOW)
            starts = places(begin, ids)
            there = {p: j for j, p in enumerate(starts)}
            shared = next((i for i in range(bisect.bisect_left(at, begin), len(at)) if ids[there.get(at[i], 0)] == out[i] and at[i] in there), None)
            if shared is not None:
                j = there[at[shared]]
            else:
                back, j = WINDOW - STEP, 0
                while shared is None:
                    i = max(0, bisect.bisect_right(at, begin + WINDOW - STEP - back) - 1)
                    ids = window(at[i], begin + WINDOW)
                    if i == 0 or ids[0] == out[i]:
                        shared, starts = i, places(at[i], ids)
                    back *= 2
            out[shared:], at[shared:] = ids[j:], starts[j:]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        found = [split(part) for part in stretches(texts)]
        self.learn(itertools.chain.from_iterable(pieces for pieces, _, _ in found))
        out = []
        for pieces, number, ends in found:
            packed = [self.known[p] for p in pieces]
            sizes = np.array([len(p) // 4 for p in packed])
            lengths = sizes[number]
            lengths[ends] = 0
            stops = np.cumsum(lengths)
            # The tokens of each piece, one piece after the other.
            place = np.repeat((np.cumsum(sizes) - sizes)[number] - (stops - lengths), lengths) + np.arange(stops[-1])
            ids = np.frombuffer(b"".join(packed), "<u4")[place].tobytes()
            bounds = [0, *(4 * stops[ends]).tolist()]
            out += [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids. A list may hold any id of the vocabulary; others are an error."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        parts = []
        for s in range(0, len(flat), TOKENS):
            part = flat[s : s + TOKENS]
            found = self._run("tokens", {"place": np.arange(len(part), dtype=np.int32), "id": part}, DECODE).column("bytes")
            if len(found) < len(part):
                raise ValueError("an id is not in the vocabulary")
            for rows in found.chunks:  # the ordered rows' bytes lie one after the other in the column's buffer
                bounds = np.frombuffer(rows.buffers()[1], np.int32)
                parts.append(memoryview(rows.buffers()[2])[bounds[rows.offset] : bounds[rows.offset + len(rows)]])
        data = b"".join(parts)
        sizes = np.append(0, np.cumsum(self.sizes[flat]))
        ends = sizes[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def with_ids(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df's columns but for the text, and the token ids as array<int>."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias(unused(df, "_text")))
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            first = 0
            for texts in stretches(batch.column(batch.num_columns - 1), TEXT_CHARS):
                ids = codec(path).encode(texts)
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, values)], names=schema.names)
                first += len(texts)

    return rows.mapInArrow(run, schema)


def with_text(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df's columns but for the ids, and the text that they decode to (ids null: null)."""
    keep = [f for f in df.schema.fields if f.name not in (ids, out)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(ids).alias(unused(df, "_ids")))
    schema = T.StructType([*keep, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                lists = part.column(part.num_columns - 1).to_pylist()
                texts = codec(path).decode([np.array(x or [], "<u4").tobytes() for x in lists])
                column = pa.array([None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df's columns but for the text, and of its encoding and decoding: n_tokens, ids_sha256, decoded_sha256."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = [f for f in df.schema.fields if f.name != text and f.name not in new]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias(unused(df, "_text")))
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in batches:
            first = 0
            for texts in stretches(batch.column(batch.num_columns - 1), TEXT_CHARS):
                ids = codec(path).encode(texts)
                decoded = codec(path).decode(ids)
                part = batch.slice(first, len(texts))
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(map(digest, decoded), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)
                first += len(texts)

    return rows.mapInArrow(run, schema)
