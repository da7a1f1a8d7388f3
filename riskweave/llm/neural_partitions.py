"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: the exact neighbour graph of the sample is cut into balanced parts (a greedy assignment, then
moves to the part that holds most neighbours, under a capacity), and a small network learns, for each vector, which parts
hold its neighbours.  Indexing: every row goes to its most probable part.  Search: a query goes to its most
probable parts, as many as it takes for their probabilities to reach ``MASS``, and is compared there with all rows, in
double precision on the original vectors.  Clustered data need few parts; vectors without any structure need most of them.

Parts are split into slots of about ``BLOCK`` rows by a hash, so that a part crowded by equal vectors spreads over tasks.

Edge rules: vectors that are null, zero, or hold null or non-finite components, and rows without id take no part.  Vectors
of another dimension than most of the sample have a part of their own, where they are compared with each other.  Rows with
the query's own id are the query; queries with one id count once.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.features import gathered
from riskweave.llm.vectors import best_of_pairs, matrix, packed, slots_for, usable
from riskweave.sources.scratch import staged

SAMPLE = 8192  # bound of the vectors that the parts and the network are fitted on
PARTS = 32  # at least; one for every BLOCK distinct vectors beyond that, as far as the sample allows
MASS = 0.95  # a query probes its most probable parts until their probabilities add up to this
NEIGHBOURS = 10
HIDDEN = 128
BLOCK = 4096
QUERIES = 512
SLACK = 1.1  # capacity of a part against an even share


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row by inner product, block by block."""
    k = min(k, len(x) - 1)
    near = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        product = x[s : s + 1024] @ x.T
        product[np.arange(len(product)), np.arange(s, s + len(product))] = -np.inf
        near[s : s + 1024] = np.argpartition(-product, k - 1, axis=1)[:, :k] if k else 0
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """A part for each node, none over capacity, such that few edges cross parts."""
    n, random = len(x), np.random.default_rng(5)
    capacity = int(np.ceil(SLACK * n / parts))
    centres = x[random.choice(n, parts, replace=False)]
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    order = random.permutation(n)
    for i in order:  # greedy start: most placed neighbours, then the nearest centre, where there is room
        votes = np.bincount(part[near[i]][part[near[i]] >= 0], minlength=parts) + 0.5 * (centres @ x[i])
        votes[size >= capacity] = -np.inf
        part[i] = int(np.argmax(votes))
        size[part[i]] += 1
    source, target = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(np.argmax(np.where(size < capacity, votes[i], -1)))
            if votes[i, to] > votes[i, part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def router(x: np.ndarray, target: np.ndarray, epochs: int = 15, rate: float = 0.003) -> dict:
    """One hidden layer, trained by Adam on the distribution of each row's neighbours over the parts."""
    random = np.random.default_rng(3)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    x = x / scale
    p = {
        "w1": random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, target.shape[1])), "b2": np.zeros(target.shape[1]),
    }
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        for at in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            hidden = np.maximum(x[at] @ p["w1"] + p["b1"], 0)
            d = (softmax(hidden @ p["w2"] + p["b2"]) - target[at]) / len(at)
            back = (d @ p["w2"].T) * (hidden > 0)
            grad = {"w2": hidden.T @ d, "b2": d.sum(axis=0), "w1": x[at].T @ back, "b1": back.sum(axis=0)}
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {**p, "scale": scale, "dim": x.shape[1]}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum(x / model["scale"] @ model["w1"] + model["b1"], 0)
    return softmax(hidden @ model["w2"] + model["b2"])


def fit(x: np.ndarray, parts: int = PARTS) -> dict:
    parts = max(1, min(parts, len(x) // 64))
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)  # a node is its own nearest
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.reshape(-1)]), 1.0)
    return {**router(x, target / target.sum(axis=1, keepdims=True)), "parts": parts}


def searchable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & usable("vector", zero_too=False))


def fitted(rows: DataFrame) -> dict | None:
    """Fit on at most ``SAMPLE`` rows, taken by a hash of the vector and then of the id, in one task."""
    code = F.xxhash64("vector")
    distinct = rows.agg(F.approx_count_distinct(code)).first()[0]
    parts = max(PARTS, distinct // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches, "id")
        if table.num_rows:
            column = table.column("vector").combine_chunks()
            sizes = column.value_lengths().to_numpy()
            dim = int(np.bincount(sizes).argmax())
            column = column.take(pa.array(np.flatnonzero(sizes == dim)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(matrix(column, dim), parts))])], names=["model"])

    # about twice the sample by a hash of the vector, which takes all copies or none, before copies are sought
    some = F.pmod(F.xxhash64(code), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(distinct, 1)))
    # equal vectors tell nothing about where to cut: one of each
    sample = rows.filter(some).groupBy("vector").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    got = staged(sample.select("id", "vector"), "ann-sample").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def routed(rows: DataFrame, model: dict, mass: float) -> DataFrame:
    """(id, vector, part): the most probable part of each row, and the next ones until they add up to ``mass``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size depends on parameters only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            usual, other = np.flatnonzero(sizes == m["dim"]), np.flatnonzero(sizes != m["dim"])
            column = batch.column("vector").take(pa.array(usual))
            p = probabilities(m, matrix(column, m["dim"])) if len(usual) else np.empty((0, m["parts"]))
            best = np.argsort(-p, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(p, best, axis=1), axis=1)
            wanted = np.hstack([np.ones((len(p), 1), bool), reached[:, :-1] < mass])
            row, rank = np.nonzero(wanted)
            at = pa.array(np.concatenate([usual[row], other]))
            part = np.concatenate([best[row, rank], np.full(len(other), m["parts"])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("vector").take(at), pa.array(part)], names=["id", "vector", "part"]
            )

    return rows.select("id", "vector").mapInArrow(run, "id long, vector array<double>, part int")


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", mass: float = MASS) -> DataFrame:
    """For each row that ``is_query`` picks: the ``k`` nearest other rows found, as query_id, rank, vec_id, score."""
    rows = searchable(vectors, key, vector)
    model = fitted(rows)
    if model is None:
        model = {"parts": 1, "dim": -1}
    placed = staged(routed(rows, model, 0.0), "ann-index")
    # one row for each part: at most SAMPLE / 64 + 1
    slots = {r["part"]: slots_for(r["count"], BLOCK) for r in placed.groupBy("part").count().collect()}
    n_slots = F.create_map(*[F.lit(x) for pair in (slots or {0: 1}).items() for x in pair])
    salted = placed.withColumn("slot", F.pmod(F.xxhash64("id"), F.coalesce(n_slots[F.col("part")], F.lit(1))).cast("int"))
    blocks = packed(salted.repartition("part", "slot"), BLOCK, lambda v: v)

    chosen = searchable(vectors.filter(is_query), key, vector).dropDuplicates(["id"])
    sent = routed(chosen, model, mass).filter(F.col("part").isin([*slots]))
    deal = F.pmod(F.xxhash64("id"), F.lit(slots_for(chosen.count(), QUERIES)))
    asked = packed(sent.withColumn("slot", F.lit(0)).repartition("part", deal), QUERIES, lambda v: v)
    asked = asked.drop("slot").withColumn("slot", F.explode(F.sequence(F.lit(0), n_slots[F.col("part")] - 1)))

    def search(block: dict, queries: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, x = opened(block)
        q_ids, q = opened(queries)
        products = q @ x.T
        out = []
        for i, q_id in enumerate(q_ids):
            rough = np.where(ids == q_id, -np.inf, products[i])
            if len(rough) > k:
                at_k = np.partition(rough, len(rough) - k)[len(rough) - k]
                near = np.flatnonzero(rough >= at_k - 1e-9 * (1 + abs(at_k)))
            else:
                near = np.arange(len(rough))
            near = near[ids[near] != q_id]
            score = (x[near] * q[i]).sum(axis=1)  # summed alike for every row, so that equal vectors tie
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), q_id), ids[near[best]], score[best]))
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return best_of_pairs(blocks, asked, search, k, "double")


def opened(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["body"], np.float64).reshape(-1, block["dim"])
