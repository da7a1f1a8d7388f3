"""Keys beside nulls, links under colliding hashes, empty tables."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import context_mixing, ngram_join, packing

BIG = 2**53 + 1
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_long_keys_beside_a_null_stay_whole(spark):
    rows = [(None, "one two three"), (BIG, "one two"), (BIG + 2, "three four five"), (-BIG, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    scored = context_mixing.score(docs, 5, 1)
    for made in (packed, scored):
        assert made.schema["doc_id"].dataType.simpleString() == "bigint"
        assert sorted((r.doc_id for r in made.collect()), key=str) == sorted((i for i, _ in rows), key=str)
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.doc_id for r in context_mixing.score(named, 5, 1).collect()} == {None, str(BIG), str(BIG + 2), str(-BIG)}


def test_no_link_is_lost_when_hashes_collide(spark, monkeypatch):
    """Buckets of two texts are told apart by the texts themselves, whatever the hashes say."""
    rows = [(2 * i + k, words(i, 60) + " tail" * k) for i in range(40) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.similarity_join(docs).collect()))
    assert all(links == 1 and c == i - i % 2 for i, c, links, _ in want)
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    assert sorted(map(tuple, ngram_join.similarity_join(docs).collect())) == want


def test_cut_values_of_unrelated_long_texts_rarely_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    cut = lambda: (ngram_join.mixed(ngram_join.signature(np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)))) >> np.uint64(48))
    assert np.mean([(cut() == cut()).mean() for _ in range(10)]) < 0.01


def test_joins_and_stages_on_an_empty_table(spark, sf_dir, empty):
    assert ngram_join.similarity_join(empty).count() == 0
    assert ngram_join.one_of_each(empty).columns == empty.columns
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, empty, sf_dir)
        assert done.count() == 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or done.columns == empty.columns, name
