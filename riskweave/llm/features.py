"""Hashed sparse features of whole texts, and the Arrow plumbing that two classifiers share."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm.batches import by_bytes, no_store

EDGES = re.compile(r"(\W*)(.*?)(\W*)", re.DOTALL)
MIX = np.uint64(0x9E3779B97F4A7C15)
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class TokenHashes(dict):
    """Token to 64-bit hash, remembered for at most ``limit`` tokens (then it starts afresh)."""

    def __init__(self, derive: Callable[[str], int], limit: int = 250_000):
        super().__init__()
        self.derive, self.limit = derive, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[token] = self.derive(token)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def crc(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def word_and_marks(token: str) -> int:
    """Hash of the word in the upper half; of the punctuation around it, if any, in the lower half."""
    if token.isalpha():
        return crc(token) << 32
    before, word, after = EDGES.fullmatch(token).groups()
    return crc(word) << 32 | (crc(before + " " + after) if before or after else 0)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Spread 64-bit keys over 2**bits slots."""
    keys = (keys ^ (keys >> np.uint64(31))) * MIX
    return ((keys ^ (keys >> np.uint64(29))) * PAIR >> np.uint64(64 - bits)).astype(np.int64)


def unit_counts(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots with log-scaled counts, as a vector of length one."""
    index = np.sort(index)
    first = np.flatnonzero(np.diff(index, prepend=-1))
    value = np.log1p(np.diff(first, append=len(index)))
    index = index[first]
    return index, value / np.sqrt(value @ value) if len(value) else value


class Hasher:
    """Texts to sparse vectors; subclasses say which keys a text has."""

    def __init__(self, bits: int, derive: Callable[[str], int] = word_and_marks):
        self.bits, self.hashes = bits, TokenHashes(derive)

    def keys(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return unit_counts(slots(self.keys(text or ""), self.bits))


def sparse_rows(docs: DataFrame, text: str, keep: list[str], make: Callable[[], Hasher]) -> DataFrame:
    """``keep`` columns with the sparse vector of each text: ``index`` and ``value`` arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_store()
        hasher = make()
        for batch in by_bytes(batches, len(keep)):
            vectors = [hasher.vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [
                    pa.array([v[0].astype(np.int32) for v in vectors], pa.list_(pa.int32())),
                    pa.array([v[1].astype(np.float32) for v in vectors], pa.list_(pa.float32())),
                ],
                names=[*keep, "index", "value"],
            )

    schema = T.StructType([docs.schema[k] for k in keep])
    schema = schema.add("index", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.FloatType()))
    return docs.select(*keep, docs[text].alias("text")).mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> pa.Table:
    """A bounded sample as one table in the order of its keys; without rows and columns if there are no batches."""
    parts = list(batches)
    return pa.Table.from_batches(parts).sort_by(key) if parts else pa.table({})


def scored_rows(docs: DataFrame, text: str, out: str, make: Callable[[], Hasher], model: dict) -> DataFrame:
    """Every row of ``docs`` with the logistic score of its text in a new column ``out``.

    ``model`` holds ``weights`` (2**bits floats) and ``bias``: a size that no input changes, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_store()
        hasher, weights, bias = make(), shared.value["weights"], shared.value["bias"]
        for batch in by_bytes(batches, at):
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(at).to_pylist()):
                index, value = hasher.vector(t)
                scores[i] = 1 / (1 + np.exp(-np.clip(weights[index] @ value + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
