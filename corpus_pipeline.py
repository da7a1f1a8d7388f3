"""The corpus pipeline: five stages, each works on all that its predecessor kept.

toxicity -> quality -> near duplicates -> secrets -> packing.  A stage takes (spark, docs, sf_dir); its result is written
as Parquet and read again as the next stage's documents.  All but the last return the columns of ``documents``.

Edge rules of every stage: nulls in any column stay as they are, a null text counts as empty; texts of any length are read
whole; repeated rows are judged each, but near duplicates keep one row of a class; an empty table gives no rows; further
columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import ngram_join, packing, quality, secrets, toxicity
from riskweave.llm.tables import fresh_name, table
from riskweave.sources.scratch import staged


def passing(docs: DataFrame, labels: DataFrame, learner, label: str, folds: int, held_out: int, keep) -> DataFrame:
    """Rows whose score by a model learned from the labelled rows among ``docs`` satisfies ``keep``."""
    model = learner.train(docs, labels, label, folds, held_out)
    score = fresh_name(docs, "score")
    return learner.score(docs, model, out=score).filter(keep(F.col(score))).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than toxic stay; at a score of exactly 0.5 they go.  Empty texts, and all texts where no
    toxic row is labelled, are judged by the model's bias."""
    return passing(docs, table(spark, sf_dir, "labels"), toxicity, "toxic", 5, 0, lambda score: score < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than poor stay; at a score of exactly 0.5, as without any labelled row, they stay."""
    return passing(docs, table(spark, sf_dir, "labels"), quality, "quality", 3, 1, lambda score: score >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the first row of it; texts without words all stay."""
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are replaced in the text; copied examples and all documents stay.
    Rows without a secret keep their text; ``n_chars`` follows the text unless it is null."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and offset each has; a null or empty text is one piece of one id."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL has no trained classifiers, MinHash or tokenizer: tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
