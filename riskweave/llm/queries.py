"""The registered corpus queries: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bit_sliced,
    centroid_clustering,
    context_mixing,
    neural_partitions,
    ngram_join,
    packing,
    privacy,
    quality,
    secrets,
    sentence_pieces,
    sharding,
    spelling,
    toxicity,
)
from riskweave.llm.tables import fold, table

QUERIES = {}
EXPECTED_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out_scores(spark: SparkSession, sf_dir: str, learner, label: str, folds: int, held_out: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learner.train(docs, table(spark, sf_dir, "labels"), label, folds, held_out)
    return learner.score(docs, model).select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


@query
def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    same = F.col("decoded") == F.regexp_replace("text", sentence_pieces.MARK, " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"), folds=5, held_out=1)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(spark, sf_dir, toxicity, "toxic", folds=5, held_out=0)


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


EXPECTED_SQL["op6_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_partitions.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(table(spark, sf_dir, "documents"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(spark, sf_dir, quality, "quality", folds=3, held_out=1)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in SQL: each round finds the nearest of all centroids and moves them."""
    nearest = """near{n} AS (
  SELECT r.vec_id, r.row, min([list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster]) AS best
  FROM kept r CROSS JOIN at{n} c GROUP BY r.vec_id, r.row
)"""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), at0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (
    SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})
)"""
    ]
    for n in range(rounds):
        steps.append(nearest.format(n=n))
        steps.append(f"""sums{n} AS (
  SELECT cluster, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM (
    SELECT b.best[2] AS cluster, unnest(range(1, {dim} + 1)) AS i, unnest(r.v) AS x FROM near{n} b JOIN kept r ON b.row = r.row)
  GROUP BY cluster, i
), at{n + 1} AS (
  SELECT a.cluster, coalesce(m.v, a.v) AS v FROM at{n} a LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS v FROM sums{n} GROUP BY cluster) m ON a.cluster = m.cluster
)""")
    steps.append(nearest.format(n=rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN at{rounds} c ON best[2] = c.cluster
"""


EXPECTED_SQL["op12_centroid_clustering"] = _clustering_sql()


@query
def op13_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
