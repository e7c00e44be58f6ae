"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for the tokenizer:

* Splitter. The split pattern becomes an automaton of a few states over classes of characters. A transition says whether
  a piece begins at the character. A chunk of text maps every state to a state; the maps of all chunks are
  made side by side and composed by a parallel prefix scan, so that each chunk knows its entry state.
* Counter. Byte-pair encoding of a piece becomes a transducer over bytes whose transitions carry the change of the
  number of emitted tokens. Its state is what the future needs of the past: the longest suffix that still begins some
  token, and for each position in it the last token of the encoding up to there and its count. States and transitions are compiled when first met and kept.

The counter rests on two properties of byte-pair encoding: an encoding is right when each two neighbours are right
together, and an encoding without its last token is the encoding of the shorter text. Hence exactly one suffix token is
compatible with the last token before it.

The merge ranks are those of the vocabulary file; an added special string inside a text splits it and counts one token,
as the library does by default. A null text is empty and has no tokens.
"""

from __future__ import annotations

import json
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import unused

#: Classes of characters.
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, S_T_M_D, R, E, V, L = range(11)
N_CLASSES = 11
#: Steps of a lane.
CHUNK = 64
#: Characters that are split at a time.
PIECE_CHARS = 1_000_000
#: Pieces of text whose counts a worker keeps.
KEPT = 400_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[0x1C:0x20] = OTHER  # no white space in the library's pattern
    out[ord(" ")], out[ord("'")] = BLANK, QUOTE
    for chars, kind in (("stmd", S_T_M_D), ("r", R), ("e", E), ("v", V), ("l", L)):
        for ch in chars:
            out[ord(ch)] = kind
    return out


#: States of the splitter, named by the character just read. One: the piece begins there; zero: it does not; the others
#: leave that to the next character. QUOTE_START may begin a contraction, HALF_* have read its first letter.
(
    START, LETTER_0, LETTER_1, NUMBER_0, NUMBER_1, OTHER_0, OTHER_1, QUOTE_START, HALF_RE, HALF_VE, HALF_LL, CONTRACTED,
    BLANK_FIRST, BLANK_MORE, SPACE_FIRST, SPACE_MORE,
) = range(16)
N_STATES = 16
END = N_CLASSES  # the class of the character between two texts


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins at the character before) by state * (N_CLASSES + 1) + class."""
    letters = (LETTER, S_T_M_D, R, E, V, L)
    halves = {HALF_RE: E, HALF_VE: E, HALF_LL: L}
    blanks, spaces = (BLANK_FIRST, BLANK_MORE), (BLANK_FIRST, BLANK_MORE, SPACE_FIRST, SPACE_MORE)
    others = (OTHER_0, OTHER_1)

    def after(state: int, c: int) -> int:
        if c == END:
            return START
        if c in letters:
            if state == QUOTE_START:
                return {S_T_M_D: CONTRACTED, R: HALF_RE, V: HALF_VE, L: HALF_LL}.get(c, LETTER_1)
            if state in halves:
                return CONTRACTED if c == halves[state] else LETTER_0
            return LETTER_0 if state in (LETTER_0, LETTER_1, *blanks) else LETTER_1
        if c == NUMBER:
            return NUMBER_0 if state in (NUMBER_0, NUMBER_1, *blanks) else NUMBER_1
        if c in (OTHER, QUOTE):
            if state in (*others, QUOTE_START, *blanks):
                return OTHER_0
            return QUOTE_START if c == QUOTE else OTHER_1
        return {BLANK: (BLANK_FIRST, BLANK_MORE), SPACE: (SPACE_FIRST, SPACE_MORE)}[c][state in spaces]

    def begins(state: int, c: int) -> bool:
        if state in halves:
            return c != halves[state]
        if state in (BLANK_MORE, SPACE_MORE):
            return c not in (BLANK, SPACE, END)
        return state not in (LETTER_0, NUMBER_0, OTHER_0, CONTRACTED)

    cells = [(s, c) for s in range(N_STATES) for c in range(N_CLASSES + 1)]
    return np.array([after(*x) for x in cells], np.uint8), np.array([begins(*x) for x in cells], bool)


NEXT, BEGINS = compile_splitter()


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the map of rows 0 to i, one after the other, in a logarithmic number of rounds."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


#: A state's place in the tables, and the tables of such places.
ROW = N_CLASSES + 1
NEXT_ROW = NEXT.astype(np.intp) * ROW
#: Steps after which lanes are parted into those whose entry state no longer matters and the rest.
SETTLE = 8


def chunk_maps(columns: np.ndarray) -> np.ndarray:
    """For each lane (a column) the state after it, by the state before it."""
    lanes = columns.shape[1]
    maps = np.tile(np.arange(N_STATES, dtype=np.intp) * ROW, (lanes, 1))
    for c in columns[:SETTLE]:
        maps = NEXT_ROW[maps + c[:, None]]
    settled = (maps == maps[:, :1]).all(axis=1)
    one, many = maps[settled, 0], maps[~settled]
    for c in columns[SETTLE:]:
        one = NEXT_ROW[one + c[settled]]
        if len(many):
            many = NEXT_ROW[many + c[~settled, None]]
    maps[settled], maps[~settled] = one[:, None], many
    return (maps // ROW).astype(np.uint8)


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions where a piece begins, in a sequence of classes that ends with END. Each END is a piece of its own."""
    n = len(kinds)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T).astype(np.intp)
    maps = chunk_maps(columns)
    state = np.full(lanes, ROW * START, np.intp)
    state[1:] = compose_scan(maps)[:-1, START].astype(np.intp) * ROW
    out = np.empty((chunk, lanes), bool)
    for i, c in enumerate(columns):
        cell = state + c
        out[i] = BEGINS[cell]
        state = NEXT_ROW[cell]
    # What a transition says holds for the character before it.
    return np.flatnonzero(out.T.reshape(-1)[1:n])


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of a vocabulary's merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.tokens = frozenset(tokens)
        self.prefixes = frozenset(t[:i] for t in self.tokens for i in range(len(t)))
        self.together: dict[tuple[bytes | None, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((None, 0),))
        self.states = [start]
        self.numbers = {start: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding by definition; asked only for pairs of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: bytes | None, token: bytes) -> bool:
        key = (before, token)
        found = self.together.get(key)
        if found is None:
            if len(self.together) > 4 * KEPT:
                self.together.clear()
            found = self.merge(token) == [token] if before is None else self.merge(before + token) == [before, token]
            self.together[key] = found
        return found

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte: (next state, change of the token count)."""
        suffix, past = self.states[number]
        suffix += bytes([byte])
        # past[k]: the last token of the encoding before suffix[k:], and how many tokens have come since.
        for k in range(len(suffix)):
            token = suffix[k:]
            if token in self.tokens and self.fits(past[k][0], token):
                break
        change = 1 - past[k][1]
        past = [(t, n + change) for t, n in past] + [(token, 0)]
        cut = 0
        while suffix[cut:] not in self.prefixes:
            cut += 1
        state = (suffix[cut:], tuple(past[cut:]))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        step = self.steps[number << 8 | byte] = (to, change)
        return step

    def count(self, piece: bytes) -> int:
        if len(self.states) > KEPT:
            self.reset()
        state = total = 0
        steps = self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte) or self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total


class Pieces(dict):
    """Counts of pieces that were seen before."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.counter.count(piece.encode("utf-8", "replace"))
        return n


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[Pieces, list[str]]:
    """The compiled vocabulary file, and the special strings that split texts."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    alphabet = byte_alphabet()
    raw = lambda t: bytes(alphabet[c] for c in t)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    special = [t["content"] for t in data.get("added_tokens", [])]
    vocabulary = [raw(t) for t in data["model"]["vocab"] if t not in special]
    return Pieces(Counter([(raw(a), raw(b)) for a, b in pairs], vocabulary)), special


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    if not texts:
        return np.zeros(0, np.int64)
    pieces, special = tokenizer(path)
    total = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        if special and any(s in text for s in special):
            split = regex.split("|".join(map(regex.escape, special)), text)
            total[i] = len(split) - 1
        else:
            split = [text]
        parts += split
        owner += [i] * len(split)
    joined = "\0".join(parts) + "\0"
    kinds = classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[ends] = END
    starts = piece_starts(kinds)
    stops = np.append(starts[1:], len(joined) - 1)
    real = kinds[starts] != END
    starts, stops = starts[real], stops[real]
    counts = np.fromiter((pieces[joined[a:b]] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.int64, len(starts))
    if len(pieces) > KEPT:
        pieces.clear()
    np.add.at(total, np.array(owner, np.int64)[np.searchsorted(ends, starts)], counts)
    return total


def stretches(column, most: int = PIECE_CHARS):
    """Lists of texts, of an Arrow array or a list, of about `most` characters in all; nulls are empty."""
    texts, size = [], 0
    for value in column:
        texts.append((value if isinstance(value, str) else value.as_py()) or "")
        size += len(texts[-1])
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df's columns but for the text, and n_bytes, n_tokens and over_limit. An extra column of these names is replaced."""
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in df.schema.fields if f.name != text and f.name not in new]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias(unused(df, "_text")))
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        for batch in batches:
            counts = [count_tokens(texts, path) for texts in stretches(batch.column(batch.num_columns - 1))]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
