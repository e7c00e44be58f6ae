import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from lodestone.llm import bpe, queries

PATH = queries.vocabulary("byte_bpe_50k.tiktoken")
CHARS = [*"abstmdrevlS  \n\t''12!é中\x1c\x85🎉٣½　\r\0", "  ", "<|endoftext|>", "the", "tion", " and", "aaaa"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_codec(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["", "x" * 3000, " " * 300, "ab" * 400, "aaa" * 100, "\0", "<|endoftext|>", "z" * 255, "z" * 256]
    codec = bpe.Codec(PATH)
    ids = codec.encode(texts)
    assert ids == [packed(library.encode_ordinary(t)) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert codec.encode([]) == [] and codec.decode([]) == []
    with pytest.raises(ValueError):
        codec.decode([packed([50256])])
    # Any order of ids decodes, not only what an encoder makes.
    loose = [rng.randrange(50256) for _ in range(500)]
    assert codec.decode([packed(loose)]) == [b"".join(library.decode_single_token_bytes(i) for i in loose)]


def test_forgetting_and_small_rounds(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    codec = bpe.Codec(PATH)
    for t in ["some words of a text " * 3, "and others, with 12 more", "some words"]:
        assert codec.encode([t]) == [packed(library.encode_ordinary(t))]


def test_frames(spark):
    texts = [None, "", "It's é\n\n the end", "long " * 30000, "It's é\n\n the end"]
    df = spark.createDataFrame([(i % 4, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    assert bpe.with_ids(df, PATH).columns == ["doc_id", "ids"]
    back = bpe.with_text(bpe.with_ids(df, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i % 4, t or "") for i, t in enumerate(texts))
    got = bpe.round_trip(df, PATH).collect()
    assert all(r.decoded_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for t in texts} for r in got) and len(got) == 5
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_bpe_round_trip(spark, sf_dir).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_long_words(library):
    rng = random.Random(4)
    codec = bpe.Codec(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for _ in range(60):
        alphabet = rng.choice([letters, "ab", "a", "éü中", "thein", "xyzq"])
        unit = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 11, 400])))
        text = (unit * 2000)[: rng.randrange(90, 2000)]
        texts += [text, text + "".join(rng.choice("etaoinshr") for _ in range(300)) + text[::-1]]
    texts.append("".join(rng.choice(letters) for _ in range(100_000)))
    assert codec.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]
    runs = ["a" * 200_000, "abcdefg" * 30_000, "中" * 50_000]  # the library needs too long for these
    assert codec.decode(codec.encode(runs)) == [t.encode() for t in runs]
