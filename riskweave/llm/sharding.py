"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows are numbered where they lie: a block (the partition that wrote them) and a place in it.  Shard sizes are fixed first,
at most one row apart.  How many rows each block sends to each shard is drawn as a whole: block by block, a multivariate
hypergeometric draw from the room that the shards have left, so that rows and columns of the matrix add up exactly.  A block
then deals its labels out by a random permutation of its places, the rows are exchanged, and each shard is permuted again by
sorting on random keys, in ranges of keys with known offsets.  Every order of the rows over all shards is equally likely.

The matrix has at most ``BLOCKS`` x shards counts and the offsets at most ``RANGES``, whatever the number of rows; only they
reach the driver and the tasks.  Labels and keys depend on the seed and the row's number alone, so a task that runs again
deals the same.  No row is tied to another: equal texts are dealt like any others, so a large group of copies spreads evenly.

Edge rules: nulls in any column, empty and long texts and repeated rows are rows like any others; with fewer rows than
shards the last shards are empty; an empty table gives no rows; all columns pass through, and the results get their names
lengthened by ``_`` where the table has them already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.tables import fresh_name
from riskweave.sources.scratch import scratch_path

BLOCKS = 1 << 16  # blocks of rows, at most: more partitions are written together
RANGES = 1 << 16  # key ranges over all shards, at most
RANGE_ROWS = 4096  # rows of a key range, on average, while there are fewer ranges than that
PLACE_BITS = 33  # the lower bits of monotonically_increasing_id count within a partition


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from ``good`` + ``bad`` rows are good, for counts of any size.

    Inverts the distribution function over twelve deviations around the mode; what lies beyond is less than a double resolves.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    whole = good + bad
    share = good / whole
    spread = (draws * share * (1 - share) * max(whole - draws, 1) / max(whole - 1, 1)) ** 0.5
    mode = min(max((draws + 1) * (good + 1) // (whole + 2), low), high)
    reach = int(12 * spread) + 30
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right").clip(0, last - first))


def communication_matrix(blocks: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: rows of the matrix add up to ``blocks``, columns to ``sizes``."""
    rng, room = np.random.default_rng([seed, 0]), list(sizes)
    matrix = np.zeros((len(blocks), len(sizes)), np.int64)
    for b, left in enumerate(blocks):
        others = sum(room)
        for s in range(len(sizes)):
            others -= room[s]
            sent = hypergeometric(rng, room[s], others, left)
            matrix[b, s], room[s], left = sent, room[s] - sent, left - sent
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


class Labels:
    """Shard of each place of a block: its row of the matrix, permuted; the last block is remembered."""

    def __init__(self, matrix: np.ndarray, seed: int):
        self.matrix, self.seed, self.made = matrix, seed, {}

    def of(self, block: int) -> np.ndarray:
        if block not in self.made:
            row = self.matrix[block]
            labels = np.repeat(np.arange(len(row), dtype=np.int32), row)
            self.made = {block: np.random.default_rng([self.seed, 1, block]).permutation(labels)}
        return self.made[block]


def numbered(docs: DataFrame) -> DataFrame:
    """All rows, each as a struct ``row`` with its number ``id`` (block and place), written once."""
    if docs.rdd.getNumPartitions() > BLOCKS:
        docs = docs.coalesce(BLOCKS)
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    path = scratch_path(docs.sparkSession, "numbered")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 1, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row of ``docs`` with its shard, 0 to ``shards`` - 1, and its slot there, gapless from 0."""
    if shards < 1:
        raise ValueError(f"need at least one shard, got {shards}")
    spark, rows = docs.sparkSession, numbered(docs)
    block = F.shiftright("id", PLACE_BITS)
    counted = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BLOCKS rows
    held = [0] * (1 + max((r["block"] for r in counted), default=-1))
    for r in counted:
        held[r["block"]] = r["n"]
    total = sum(held)
    matrix = communication_matrix(held, even_sizes(total, shards), seed)
    ranges = max(1, min(RANGES // shards, -(-total // (shards * RANGE_ROWS))))
    shared = spark.sparkContext.broadcast(Labels(matrix, seed))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            blocks, places = ids >> PLACE_BITS, ids & ((1 << PLACE_BITS) - 1)
            to = np.empty(len(ids), np.int32)
            for b in np.unique(blocks).tolist():
                at = blocks == b
                to[at] = labels.of(b)[places[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=[*batch.schema.names, "to"])

    def with_keys(frame: DataFrame) -> DataFrame:
        """The row's shard, its random key, and the range of keys that one falls in."""
        schema = T.StructType([*frame.schema.fields, T.StructField("to", T.IntegerType())])
        made = frame.mapInArrow(dealt, schema).withColumn("key", F.xxhash64(F.lit(seed), "id"))
        top = F.pmod(F.shiftright("key", 40), F.lit(1 << 24))
        return made.withColumn("range", F.floor(top * ranges / F.lit(1 << 24)).cast("int"))

    sizes = with_keys(rows.select("id")).groupBy("to", "range").agg(F.count(F.lit(1)).alias("n")).collect()  # at most RANGES rows
    count = np.zeros((shards, ranges), np.int64)
    for r in sizes:
        count[r["to"], r["range"]] = r["n"]
    starts = [(s, g, int(x)) for s, row in enumerate(count.cumsum(axis=1) - count) for g, x in enumerate(row)]
    offsets = spark.createDataFrame(starts, "to int, range int, start long")
    order = Window.partitionBy("to", "range").orderBy("key", "id")
    placed = with_keys(rows).withColumn("place", F.row_number().over(order)).join(F.broadcast(offsets), ["to", "range"])
    shard = fresh_name(docs, shard)
    slot = fresh_name(docs.withColumn(shard, F.lit(0)), slot)
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("to").alias(shard),
        (F.col("start") + F.col("place") - 1).alias(slot),
    )
