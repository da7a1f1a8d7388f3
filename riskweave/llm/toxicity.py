"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (P) and texts without any label (U), never a confirmed clean text.  With the class
prior pi its risk is pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]): the second part estimates the risk on
clean texts, and where a batch drives it below zero the step goes the other way, so the classifier cannot win by calling
all of U clean.  A linear numpy classifier with logistic loss is trained by Adam in one task on bounded samples of P and U;
documents are hashed and scored where they lie.

Features are words and the first four letters of words, lower-case, the latter because insults are inflected.

Edge rules: a null or empty text has no features and gets the bias as its score; texts of any length are read whole;
null keys and labels other than 0 and 1 are not learned from; repeated rows are scored each.  Without a confirmed toxic
text, or without unlabelled ones, every score is the class prior (0 if nothing is labelled).  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.features import Hasher, crc, gathered, scored_rows, slots, sparse_rows
from riskweave.llm.tables import fold, labelled_sample
from riskweave.sources.scratch import staged

BITS = 18
POSITIVES = 4000  # bound of the sample of confirmed toxic texts
UNLABELLED = 12000  # bound of the sample of texts without a label
STEPS = 300
LOW = np.uint64(0xFFFFFFFF)


def word_and_stem(token: str) -> int:
    word = token if token.isalpha() else "".join(c for c in token if c.isalpha())
    word = word.lower()
    return crc(word) << 32 | crc("^" + word[:4]) if word else 0


class Words(Hasher):
    def __init__(self, bits: int = BITS):
        super().__init__(bits, word_and_stem)

    def keys(self, text: str) -> np.ndarray:
        both = self.hashes.of(text.split())
        both = both[both > 0]
        return np.concatenate([both >> np.uint64(32), (both & LOW) + (LOW << np.uint64(1))])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Presence only, whatever the length: one insult counts the same in a long text as in a short one."""
        index = np.unique(slots(self.keys(text or ""), self.bits))
        return index, np.ones(len(index))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Batch:
    """Sparse rows laid end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(i) for i, _ in rows])
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n) + b

    def slope(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, self.value * by_row[self.row], size)


def telling(positive: list, unlabelled: list, prior: float, size: int, least: float) -> np.ndarray:
    """Slots whose share of texts is larger in P than in U by ``least`` standard errors and by half of 1 / prior.

    A slot that only toxic texts have is 1 / prior times as frequent in P as in U, where its toxic texts are mixed in.
    """
    p, u = (np.bincount(np.concatenate([i for i, _ in rows]), minlength=size) for rows in (positive, unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    pooled = (p + u + 1) / (n_p + n_u + 2)
    above = p / n_p - u / n_u >= least * np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    return above & (p / n_p >= 0.5 / prior * u / n_u)


def non_negative_pu(
    positive: list, unlabelled: list, prior: float, bits: int, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4, least: float = 6.0
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over the slots that tell P from U."""
    size = 1 << bits
    used = telling(positive, unlabelled, prior, size, least)
    P, U = (Batch([(i[used[i]], v[used[i]]) for i, v in rows]) for rows in (positive, unlabelled))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        at_p, at_u = P.margins(w, b), U.margins(w, b)
        clean_risk = softplus(at_u).mean() - prior * softplus(at_p).mean()
        p_minus, u_minus = sigmoid(at_p) * prior / P.n, sigmoid(at_u) / U.n  # slopes of the loss as clean
        if clean_risk >= 0:
            g_p, g_u = -sigmoid(-at_p) * prior / P.n - p_minus, u_minus
        else:
            g_p, g_u = p_minus, -u_minus
        grad = np.append(P.slope(g_p, size) + U.slope(g_u, size) + decay * w, g_p.sum() + g_u.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:size]
        b -= move[size]
    return w.astype(np.float32), b


def train(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, key: str = "doc_id", text: str = "text"
) -> dict:
    """Fit on at most ``POSITIVES`` confirmed toxic and ``UNLABELLED`` unlabelled texts outside the held-out fold.

    The class prior is the share of toxic rows among all labelled rows outside that fold.
    """
    learnable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(key, folds) != held_out))
    prior = learnable.agg(F.avg(label)).first()[0]
    if not prior or prior >= 1:
        return constant(prior or 0.0)
    toxic = labelled_sample(labels, label, folds, held_out, POSITIVES, key).filter("label = 1")
    others = (
        docs.select(key)
        .filter(F.col(key).isNotNull() & (fold(key, folds) != held_out))
        .join(labels.filter(F.col(label).isNotNull()).select(key), key, "left_anti")
        .orderBy(F.xxhash64(key), F.col(key))
        .limit(UNLABELLED)
        .select(key, F.lit(0).alias("label"))
    )
    # both samples are bounded by the constants above, so their keys may be broadcast
    picked = F.broadcast(toxic.unionByName(others))
    chosen = docs.select(key, text).join(picked, key).dropDuplicates([key])
    vectors = staged(sparse_rows(chosen, text, [key, "label"], Words), "toxicity-sample")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, key)
        known = rows["label"].to_numpy() == 1 if rows.num_rows else np.empty(0, bool)
        if known.any() and not known.all():
            pairs = list(zip(rows["index"].to_numpy(), rows["value"].to_numpy(), strict=True))
            weights, bias = non_negative_pu(
                [x for x, k in zip(pairs, known, strict=True) if k],
                [x for x, k in zip(pairs, known, strict=True) if not k],
                prior,
                BITS,
            )
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    fitted = vectors.coalesce(1).mapInArrow(fit, "weights binary, bias double").collect()
    if not fitted:
        return constant(prior)
    return {"weights": np.frombuffer(fitted[0]["weights"], np.float32), "bias": fitted[0]["bias"]}


def constant(prior: float) -> dict:
    prior = min(max(prior, 1e-9), 1 - 1e-9)
    return {"weights": np.zeros(1 << BITS, np.float32), "bias": float(np.log(prior / (1 - prior)))}


def score(docs: DataFrame, model: dict, out: str = "score", text: str = "text") -> DataFrame:
    """Every row with a score in 0..1, higher where the text is likelier toxic."""
    return scored_rows(docs, text, out, Words, model)
