"""Vectors in blocks: a stated set of queries meets all rows, block by block.

Rows and queries are packed into binary block rows, so that a pair of blocks is one joined row.  Both sides carry a slot:
every block of rows has one, every block of queries is sent to all slots it has to meet.  A task sees one pair of blocks
at a time, and what leaves it are the best few rows of each query, which a window with a group limit merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKED = "dim int, part int, slot int, n int, ids binary, body binary"


def usable(vector: str, zero_too: bool) -> Column:
    """Not null, every component there and finite, and (unless ``zero_too``) some component other than zero."""
    v, infinite = F.col(vector), float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return v.isNotNull() & (fine if zero_too else fine & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all hold ``dim`` values, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def packed(
    rows: DataFrame, size: int, encode: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """(part, slot, id, vector) rows as block rows of at most ``size`` vectors of one dimension, part and slot.

    Rows are packed in the partition where they lie, so sort or deal them out before.
    """

    def block(ids: np.ndarray, vectors: np.ndarray, key: tuple) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        body = encode(vectors[order]).tobytes()
        dim, part, slot = key
        values = [[dim], [part], [slot], [len(ids)], [ids[order].tobytes()], [body]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["dim", "part", "slot", "n", "ids", "body"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(), batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.stack([sizes, batch.column("part").to_numpy(), batch.column("slot").to_numpy()], axis=1)
            for key in np.unique(keys, axis=0) if len(keys) else []:
                at = np.flatnonzero((keys == key).all(axis=1))
                key = tuple(int(x) for x in key)
                parts = held.setdefault(key, [])
                parts.append((ids[at], matrix(vectors.take(pa.array(at)), key[0])))
                while sum(len(i) for i, _ in parts) >= size:
                    i, v = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
                    yield block(i[:size], v[:size], key)
                    parts[:] = [(i[size:], v[size:])]
        for key, parts in held.items():
            if n := sum(len(i) for i, _ in parts):
                i, v = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
                assert len(i) == n
                yield block(i, v, key)

    return rows.select("part", "slot", "id", "vector").mapInArrow(run, PACKED)


def best_of_pairs(
    blocks: DataFrame,
    queries: DataFrame,
    search: Callable[[dict, dict], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]],
    k: int,
    score_type: str,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows over all pairs of blocks with equal dim, part and slot.

    ``search(block, queries)`` yields (query ids, row ids, scores), at most ``k`` rows a query being worth while.
    """
    on = ["dim", "part", "slot"]
    side = lambda f, p: f.select(*on, *[F.col(c).alias(p + c) for c in ("n", "ids", "body")])
    pairs = side(blocks, "b_").join(side(queries, "q_"), on)
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                b, q = ({c: row[p + c] for c in ("n", "ids", "body")} | {"dim": row["dim"]} for p in ("b_", "q_"))
                for found in search(b, q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), kind), strict=True)],
                        names=["query_id", "vec_id", "score"],
                    )

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def slots_for(n_rows: int, size: int) -> int:
    return max(1, -(-n_rows // size))


def to_slots(queries: DataFrame, slots: Column) -> DataFrame:
    """Each block of queries once for every slot 0..slots-1."""
    return queries.drop("slot").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
