import hashlib

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, quality
from tests.llm import brute
from tests.llm.test_decontaminate import sellers
from tests.llm.test_shingles import plain_kept


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    out = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rejected = {r[0] for r in docs.where(quality.cascade(docs.text, quality.DEFAULT_RULES).isNotNull()).select("doc_id").collect()}
    want = {d: t for d, t in texts.items() if d not in rejected and not brute.quality(t)["base_failed"]}
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and 0 < len(want) < len(texts)

    docs = spark.createDataFrame(rows, docs.schema)
    gone = brute.dedup_lines(want)
    cut = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in want.items()}
    want = {d: t for d, t in cut.items() if brute.WORD.search(t) or d not in gone}
    out = corpus_pipeline.line_stage(spark, docs, sf_dir)
    rows = out.collect()
    assert out.columns == docs.columns and {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)

    docs = spark.createDataFrame(rows, docs.schema)
    kept, _ = plain_kept(want)
    want = {d: t for d, t in want.items() if d in kept}
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    rows = out.collect()
    assert out.columns == docs.columns and {r.doc_id: r.text for r in rows} == want

    docs = spark.createDataFrame(rows, docs.schema)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    segments = [s for _, t in items for _, s in decontaminate.cut(decontaminate.normal(t))]
    index = decontaminate.build_index(items)
    out = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    rows = out.collect()
    kept = {r.doc_id for r in rows}
    for d, t in want.items():
        t = decontaminate.normal(t)
        if any(s in t for s in segments):
            assert d not in kept
        elif d not in kept:
            _, item, at, edits, start, end = next(decontaminate.search([t], index))
            segment = dict(decontaminate.cut(decontaminate.normal(dict(items)[item])))[at]
            assert sellers(segment, t[max(0, start - 30) : end + 30]) == edits <= 0.1 * len(segment)
    assert out.columns == docs.columns

    docs = spark.createDataFrame(rows, docs.schema)
    codec = bpe.Codec(corpus_pipeline.vocabulary("byte_bpe_50k.tiktoken"))
    got = corpus_pipeline.encoding_stage(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in got} == kept
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(codec.encode([want[r.doc_id]])[0]).hexdigest()

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got))


def test_a_very_long_text(spark, sf_dir):
    """A text of 60,000 words beside short ones goes through every stage, whole."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    long = "\n".join(" ".join(f"long{i + j}" for j in range(12)) for i in range(0, 60_000, 12))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, " ".join(f"word{i}" for i in range(60)), "en", "s", 5)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id: r.text == long for r in docs.collect()} == {1: True, 3: False}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.encoding_stage(spark, docs, sf_dir).collect()}
    assert set(got) == {1, 3} and got[1] == hashlib.sha256(long.encode()).hexdigest()


def test_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (None, good + " end", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, f"other text {good[::-1]}", "en", "s", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == corpus_pipeline.COLUMNS
        got = corpus_pipeline.encoding_stage(spark, docs, sf_dir).collect()
        assert sorted(r.doc_id for r in got) == ([] if frame.isEmpty() else [1, 4])
    extra = spark.createDataFrame([(*r, "mine") for r in rows], schema.add("_key", "string"))
    assert corpus_pipeline.quality_stage(spark, extra, sf_dir).columns == corpus_pipeline.COLUMNS
