import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import fst_tokens, queries

PATH = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


CHARS = [*"abstmdrevlS  \n\t''12!é中\x1c\x85🎉٣½　\r\0", "  ", "<|endoftext|>", "the", "tion", " and", "'re", "'ll"]


def test_counts_equal_the_library(library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["", "x" * 4000, " " * 300, "<|endoftext|>", "\0", "'", "a'"]
    assert fst_tokens.count_tokens(texts, PATH).tolist() == lengths(library, texts)
    assert fst_tokens.count_tokens([], PATH).tolist() == []


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_compose(chunk):
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, fst_tokens.N_CLASSES + 1, 3000).astype(np.uint8)
    kinds[-1] = fst_tokens.END
    assert fst_tokens.piece_starts(kinds, chunk).tolist() == fst_tokens.piece_starts(kinds, 5000).tolist()


def test_scan_is_composition():
    rng = np.random.default_rng(2)
    maps = rng.integers(0, 16, (37, 16)).astype(np.uint8)
    got, state = fst_tokens.compose_scan(maps), np.arange(16)
    for i, m in enumerate(maps):
        state = m[state]
        assert (got[i] == state).all()


def test_counter_forgets_without_harm(monkeypatch, library):
    monkeypatch.setattr(fst_tokens, "KEPT", 50)
    texts = ["thblebleingtiofherent and " + "xyzzy" * i for i in range(60)]
    assert fst_tokens.count_tokens(texts, PATH).tolist() == lengths(library, texts)


def test_frames(spark, library):
    texts = [None, "", "It's the end.\n\nOf it", "word " * 50000, "It's the end.\n\nOf it"]
    df = spark.createDataFrame([(i % 4, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = fst_tokens.with_token_counts(df, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted(
        (len((t or "").encode()), n, n > 512) for t, n in zip(texts, lengths(library, [t or "" for t in texts]))
    )
    assert fst_tokens.with_token_counts(df.limit(0), PATH).collect() == []


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], lengths(library, [r.text for r in docs])))
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf_dir).collect()} == want
