"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Learning: a bounded sample of labelled rows is hashed where the documents lie; one task then runs FTRL-proximal over the
sparse vectors (per-coordinate steps, L1 and L2).  Scoring: a sparse dot product per text, where the text lies.

Edge rules: a null or empty text has no features and gets the model's bias as its score; texts of any length are read
whole; a label that is null or neither 0 nor 1 and a null key are not learned from; repeated rows are scored each.  With
no labelled row at all every score is 0.5.  Columns beyond key and text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.features import PAIR, Hasher, gathered, scored_rows, sparse_rows
from riskweave.llm.tables import labelled_sample
from riskweave.sources.scratch import staged

BITS = 18
PER_CLASS = 4000  # bound of the labelled sample, for each class
EPOCHS = 4


LOW = np.uint64(0xFFFFFFFF)
REPEATED = np.uint64(1 << 40)  # stands for any word followed by itself


class WordPairs(Hasher):
    """Words, the punctuation around them, and pairs of neighbours; case stays, as it tells of quality.

    All pairs of a word with itself share one key: repetition tells of quality whatever the word is.
    """

    def __init__(self, bits: int = BITS):
        super().__init__(bits)

    def keys(self, text: str) -> np.ndarray:
        both = self.hashes.of(text.split())
        word, marks = both >> np.uint64(32), both & LOW
        pair = np.where(word[:-1] == word[1:], REPEATED, word[:-1] * PAIR + word[1:] + np.uint64(1))
        return np.concatenate([word, marks[marks > 0] + (LOW << np.uint64(1)), pair])


def follow_the_regularised_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    bits: int,
    epochs: int = EPOCHS,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes; both classes weigh as they occur."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)

    def leader(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = leader(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - labels[i]) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    w = leader(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def train(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, key: str = "doc_id", text: str = "text"
) -> dict:
    """Fit on at most ``PER_CLASS`` labelled rows a class whose fold is not ``held_out``."""
    picked = labelled_sample(labels, label, folds, held_out, PER_CLASS, key)
    # the sample is bounded by PER_CLASS, so its keys may be broadcast
    chosen = docs.select(key, text).join(F.broadcast(picked), key).dropDuplicates([key])
    vectors = staged(sparse_rows(chosen, text, [key, "label"], WordPairs), "quality-sample")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, key)
        if rows.num_rows:
            pairs = list(zip(rows["index"].to_numpy(), rows["value"].to_numpy(), strict=True))
            weights, bias = follow_the_regularised_leader(pairs, rows["label"].to_numpy(), BITS)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    fitted = vectors.coalesce(1).mapInArrow(fit, "weights binary, bias double").collect()
    if not fitted:
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": 0.0}
    return {"weights": np.frombuffer(fitted[0]["weights"], np.float32), "bias": fitted[0]["bias"]}


def score(docs: DataFrame, model: dict, out: str = "score", text: str = "text") -> DataFrame:
    """Every row with a score in 0..1, higher where label 1 is likelier."""
    return scored_rows(docs, text, out, WordPairs, model)
