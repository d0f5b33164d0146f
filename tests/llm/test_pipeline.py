"""The pipeline against a plain version of each stage, on the smallest documents."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontamination, mixing, near_dups, quality_rules, token_files
from tests.llm.test_operators import brute_components
from tests.oracle import SMALL


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    good = {r.doc_id for r in quality_rules.with_verdicts(quality_rules.measures(docs)).filter("qr_kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    one = {d for d, _, c in brute_components(rows, 5) if d == c}
    clean = {r.dc_id for r in decontamination.find_hits(docs, bench).filter("size(dc_spans) = 0").collect()}
    left = docs.filter(docs.doc_id.isin([d for d in one if d in clean]))
    copies = {r.doc_id: r.mix_copies for r in mixing.plan_copies(left).collect()}
    tokenizer, start, expected = Tokenizer.from_file(token_files.vocabulary_path()), 0, []
    for d, text in rows:
        for _ in range(copies.get(d, 0)):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert found == sorted(expected)


def test_empty(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SMALL)
        assert out.count() == 0
    assert near_dups.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("k", range(4))
def test_columns_stay(spark, k):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SMALL).columns == docs.columns


def test_rows_without_id_stay(spark):
    """Of each component without an id one row stays, whatever number of them there is; copies of a document go."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = texts["b"] + " more"
    rows = [(1, texts["a"]), (None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, near), (None, texts["c"]), (None, texts["d"]), (None, None), (None, " "), (2, "own words only"), (2, "own words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dups.keep_one(docs).collect()]
    b = [r for r in kept if r[1] in (texts["b"], near)]
    assert len(b) == 1 and b[0][0] is None
    rest = [(1, texts["a"]), (None, texts["c"]), (None, texts["d"]), (None, None), (None, " "), (2, "own words only")]
    assert sorted((r for r in kept if r not in b), key=str) == sorted(rest, key=str)
