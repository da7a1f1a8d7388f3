"""Exact top-k by integer inner product over a bit-sliced index.

A component x counts as floor(1024 * x).  The index holds, for each block of rows and each component, one bitmap per binary
digit.  A query's score is a weighted sum of components, so it is computed for a whole block at once: every set bit of
every weight adds shifted bitmaps, and carry-save adders bring them down to the slices of the sum (a negative weight adds
the complement).  The top rows are then selected from the most significant slice downward; when only a few rows are still
open, or all slices are read, the boundary rows are resolved exactly: by their full scores, then by the smaller id.

Scores of narrow vectors, whose components are at most 2**20 / sqrt(dimension) in size, fit 64 bits by far and come from
the index.  A pair with a wider vector is scored in integers of any length, block by block; its score counts as the nearest
64-bit value.

Edge rules: vectors that are null, or hold null or non-finite components, and rows without id take no part.  Vectors of
another dimension than the query's are no candidates.  Rows with the query's own id are the query; of several queries with
one id one counts.  Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.vectors import best_of_pairs, packed, slots_for, to_slots, usable
from riskweave.sources.scratch import staged

SCALE = 1024
BLOCK = 8192  # rows of a block: 128 words a bitmap
QUERIES = 256  # queries of a block
WIDE_BLOCK = 1024  # rows of a block that is scored in integers of any length
NARROW = 1 << 20
ONE = np.uint64(1)


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def sliced(vectors: np.ndarray) -> np.ndarray:
    """Header (bits, then the least value of each component) and the bitmaps [component, bit, word]."""
    values = quantised(vectors)
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(values) // 64)
    maps = np.zeros((values.shape[1], bits, words * 64), np.uint8)
    for b in range(bits):
        maps[:, b, : len(values)] = ((above >> np.uint64(b)) & ONE).T
    packed_maps = np.packbits(maps, axis=2, bitorder="little").view(np.uint64)
    return np.concatenate([[bits], low, packed_maps.reshape(-1).view(np.int64)])


class Slices:
    """A block of the index, opened for queries."""

    def __init__(self, body: bytes, ids: bytes, dim: int):
        raw = np.frombuffer(body, np.int64)
        self.ids, self.bits, self.low = np.frombuffer(ids, np.int64), int(raw[0]), raw[1 : 1 + dim]
        maps = raw[1 + dim :].view(np.uint64).reshape(dim, self.bits, -1)
        self.signed = np.stack([maps, ~maps])
        self.all = np.packbits(np.arange(maps.shape[2] * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(weight * component) less a constant, least significant first."""
        sign, size = (weights < 0).astype(np.int64), np.abs(weights)
        columns: dict[int, list[np.ndarray]] = {}
        for k in range(int(size.max(initial=0)).bit_length()):
            used = np.flatnonzero(size >> k & 1)
            for b in range(self.bits):
                columns.setdefault(k + b, []).append(self.signed[sign[used], used, b])
        slices, w = [], 0
        while columns:
            rows = np.concatenate(columns.pop(w, [self.signed[0][:0, 0]]))
            while len(rows) > 1:
                third = len(rows) // 3
                if third:
                    x, y, z = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                    half = x ^ y
                    carry, rows = (x & y) | (half & z), np.concatenate([half ^ z, rows[3 * third :]])
                else:
                    carry, rows = rows[:1] & rows[1:], rows[:1] ^ rows[1:]
                columns.setdefault(w + 1, []).append(carry)
            slices.append(rows[0] if len(rows) else np.zeros_like(self.all))
            w += 1
        return slices

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of a few rows, put together from their digits."""
        digits = self.signed[0][:, :, rows >> 6] >> (rows & 63).astype(np.uint64) & ONE
        values = (digits << np.arange(self.bits, dtype=np.uint64)[None, :, None]).sum(axis=1).astype(np.int64)
        return weights @ (values + self.low[:, None])

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ids and scores of the ``k`` best rows other than the query's own."""
        open_rows = self.all & ~bitmap(np.flatnonzero(self.ids == query_id), len(self.all))
        sure = np.zeros_like(open_rows)
        for s in reversed(self.weighted_sum(weights)):
            if count(sure) + count(open_rows) <= 2 * k:
                break
            with_bit = sure | (open_rows & s)
            n = count(with_bit)
            if n > k:
                open_rows &= s
            else:
                sure, open_rows = with_bit, open_rows & ~s
                if n == k:
                    open_rows[:] = 0
        rows, more = positions(sure), positions(open_rows)
        if len(rows) + len(more) > 2 * k:  # all digits read: the open rows tie, and ids rise with the position
            more = more[: k - len(rows)]
        rows = np.concatenate([rows, more])
        scores = self.scores(rows, weights)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def bitmap(rows: np.ndarray, words: int) -> np.ndarray:
    made = np.zeros(words, np.uint64)
    np.bitwise_or.at(made, rows >> 6, ONE << (rows & 63).astype(np.uint64))
    return made


def searchable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The vectors that take part, all in one part and slot."""
    rows = vectors.select(
        F.lit(0).alias("part"), F.lit(0).alias("slot"), F.col(key).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    return rows.filter(F.col("id").isNotNull() & usable("vector", zero_too=True) & (F.size("vector") > 0))


def is_narrow() -> Column:
    most = F.lit(float(NARROW)) / F.sqrt(F.size("vector"))
    return F.forall("vector", lambda x: F.abs(x) <= most)


def unbounded(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of every component in integers of any length."""
    whole = [[int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in v] for v in vectors.tolist()]
    made = np.empty(vectors.shape, object)
    made[:] = whole
    return made


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The bit-sliced index of all usable vectors, one row a block, written once."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    blocks = packed(searchable(vectors, key, vector).filter(is_narrow()), BLOCK, sliced)
    return staged(blocks.withColumn("slot", spread), "slices")


def met(blocks: DataFrame, asked: DataFrame, encode: Callable[[np.ndarray], np.ndarray], search: Callable, k: int) -> DataFrame:
    """The best ``k`` rows of ``blocks``, whose slots are any numbers, for each of the rows ``asked``."""
    slots = max(1, blocks.count())
    wanted = packed(asked.repartition(slots_for(asked.count(), QUERIES)), QUERIES, encode)
    blocks = blocks.withColumn("slot", F.pmod("slot", F.lit(slots)))
    return best_of_pairs(blocks, to_slots(wanted, F.lit(slots)), search, k, "long")


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` picks: its ``k`` best other rows as query_id, rank, vec_id, score."""
    rows = searchable(vectors, key, vector)
    asked = staged(searchable(vectors.filter(is_query), key, vector).dropDuplicates(["id"]), "top-k-queries")

    def by_slices(block: dict, queries: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        slices = Slices(block["body"], block["ids"], block["dim"])
        ids = np.frombuffer(queries["ids"], np.int64)
        weights = np.frombuffer(queries["body"], np.int64).reshape(len(ids), -1)
        best = [slices.top(q, w, k) for q, w in zip(ids.tolist(), weights, strict=True)]
        found, scores = (np.concatenate(x) for x in zip(*best, strict=True))
        yield np.repeat(ids, [len(r) for r, _ in best]), found, scores

    def by_long_integers(block: dict, queries: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        (ids, values), (q_ids, weights) = (
            (np.frombuffer(b["ids"], np.int64), unbounded(np.frombuffer(b["body"], np.float64).reshape(-1, b["dim"]))) for b in (block, queries)
        )
        for q, w in zip(q_ids.tolist(), weights, strict=True):
            scored = ((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in zip(values @ w, ids.tolist(), strict=True) if i != q)
            best = heapq.nsmallest(k, scored)
            yield np.full(len(best), q), np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)

    best = met(index(vectors, key, vector), asked.filter(is_narrow()), quantised, by_slices, k)
    wide = staged(rows.filter(~is_narrow()), "wide-vectors")
    if wide.isEmpty():
        return best
    plain = lambda v: v
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    wide_blocks, narrow_blocks = (
        staged(packed(r, WIDE_BLOCK, plain).withColumn("slot", spread), "wide-blocks") for r in (wide, rows.filter(is_narrow()))
    )
    found = best.unionByName(met(wide_blocks, asked, plain, by_long_integers, k))
    found = found.unionByName(met(narrow_blocks, asked.filter(~is_narrow()), plain, by_long_integers, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
