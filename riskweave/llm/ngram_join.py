"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are compared as sets of word five-grams.  Texts with the same set are one class of copies from the start.  Candidates
are texts that agree in a band of MinHash values.  In a bucket of such texts, pairs are compared 16 MinHash values at a time;
a pair is dropped as soon as the posterior probability that its similarity reaches the threshold, given the agreements so
far and a flat prior, falls below ``TOLERANCE``.  What is left connects texts into candidate groups, and within each group
the similarity of all pairs is computed exactly from the whole sets.

A bucket or group is cut into chunks, and a task sees one pair of chunks, so its size is bounded whatever the group's.
Pairs never leave a task: it hands on each text's number of links and edges that span its connected texts.

A pair at the threshold shares no band with probability (1 - 0.8**4)**24, about 3 in a million, and less above it.

Edge rules: words are lower-case and blank-separated; a text of one to four words has one n-gram, all of it; null and empty
texts have none and are in a class of their own, without links; texts of any length are read whole; repeated rows are copies
of each other; the class id is the least key in the class, null if no row of it has a key; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.batches import by_bytes, no_store
from riskweave.llm.components import components
from riskweave.llm.features import TokenHashes
from riskweave.sources.scratch import staged

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16  # MinHash values compared before each decision
TOLERANCE = 1e-6
CHUNK = 256  # texts of a chunk
CHUNK_GRAMS = 1 << 20  # n-grams of a chunk, on average

RANDOM = np.random.default_rng(20)
FACTORS = RANDOM.integers(0, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def grams(text: str, hashes: TokenHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return words
    n = max(1, len(words) - N + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(N, len(words))):
        total += words[i : i + n] * FACTORS[i]
    return np.unique(mixed(total))


def signature(gram_set: np.ndarray) -> np.ndarray:
    """The least of each permutation of the set, whole."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(gram_set), 2048):
        least = np.minimum(least, (gram_set[s : s + 2048, None] * MULTIPLY + ADD).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * FACTORS[r] + least.reshape(BANDS, ROWS)[:, r])
    return keys.view(np.int64)


def fewest_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest agreements at which a pair is kept.

    With a flat prior the posterior after m of n agreements is Beta(m + 1, n - m + 1), and the probability that the
    similarity is ``threshold`` or more equals that of m or fewer successes in n + 1 trials at ``threshold``.
    """
    fewest = {}
    for n in range(STEP, VALUES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                fewest[n] = m
                break
    return fewest


def likely_pairs(sigs: np.ndarray, first: np.ndarray, second: np.ndarray, fewest: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (first[i], second[i]) those that no decision drops."""
    agree = np.zeros(len(first), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        part = slice(n - STEP, n)
        agree += (sigs[first, part] == sigs[second, part]).sum(axis=1)
        keep = agree >= fewest[n]
        first, second, agree = first[keep], second[keep], agree[keep]
    return first, second


def pairs_within(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions to compare: all pairs of one chunk, or all of one chunk with all of the other."""
    if same:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def spanning(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each of n positions the least position it is connected to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, first, root[second])
        np.minimum.at(new, second, root[first])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over a few thousand n-grams at a time."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    column = np.cumsum(np.concatenate([[True], every[1:] != every[:-1]])) - 1 if len(every) else np.empty(0, np.int64)
    often = np.bincount(column)[column] > 1 if len(every) else np.empty(0, bool)
    column, row = column[often], row[often]
    together = np.zeros((len(sets), len(sets)), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        for s in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, [s, s + 2048])
            dense = np.zeros((len(sets), 2048), np.float32)
            dense[row[a:b], column[a:b] - s] = 1
            together += dense @ dense.T
    return together


def signed(docs: DataFrame, key: str, text: str, carry: bool = False) -> DataFrame:
    """Each row with a row number, a digest of its n-gram set, the set's size, its signature and band keys; written once.

    ``carry`` keeps the other columns in a struct ``rest``, whatever their names.
    """
    others = [F.col(c) for c in docs.columns if c not in (key, text)]
    rest = [F.struct(F.lit(0).alias("_"), *others).alias("rest")]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *rest * carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_store()
        hashes = TokenHashes(word_hash)
        for batch in by_bytes(batches, 1):
            digest, size, sig, bands = [], [], [], []
            for t in batch.column("text").to_pylist():
                gram_set = grams(t or "", hashes)
                size.append(len(gram_set))
                if len(gram_set):
                    least = signature(gram_set)
                    digest.append(hashlib.blake2b(gram_set.tobytes(), digest_size=16).digest())
                    # minima crowd near 0, so they are mixed before they are cut
                    sig.append((mixed(least) >> np.uint64(48)).astype(np.uint16).tobytes())
                    bands.append(band_keys(least))
                else:
                    digest.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(digest, pa.binary()), pa.array(size, pa.int64()),
                    pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, "digest", "size", "sig", "bands"],
            )

    schema = T.StructType([*rows.schema.fields]).add("digest", "binary").add("size", "long").add("sig", "binary")
    made = rows.mapInArrow(run, schema.add("bands", T.ArrayType(T.LongType())))
    return staged(made.withColumn("row_id", F.monotonically_increasing_id()), "signed")


def in_chunk_pairs(members: DataFrame, group: str, chunks: str) -> DataFrame:
    """Deal members of each group to pairs of chunks: columns ``c1``, ``c2`` and the member's ``side`` (0 or 1)."""
    own = F.pmod(F.xxhash64(F.lit(1), "id"), F.col(chunks))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)))
    return (
        dealt.withColumn("c1", F.least("own", "other"))
        .withColumn("c2", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .drop("own", "other", chunks)
        .repartition(group, "c1", "c2")
        .sortWithinPartitions(group, "c1", "c2", "id")
    )


def by_chunk_pair(dealt: DataFrame, group: str, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """Apply ``work(columns of one pair of chunks)`` to each run of equal (group, c1, c2)."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ends = run_ends(held)
            if len(ends) > 1:
                yield from done(held, ends[:-1])
                held = held.slice(ends[-2])
        if held is not None and held.num_rows:
            yield from done(held, run_ends(held))

    def run_ends(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy() for c in (group, "c1", "c2")])
        return np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, table.num_rows)

    def done(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = {c: table.column(c).to_pylist() if pa.types.is_binary(table.column(c).type) else table.column(c).to_numpy() for c in columns}
        c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
        out, begin = [[] for _ in names], 0
        for end in ends:
            made = work({c: v[begin:end] for c, v in values.items()}, bool(c1[begin] == c2[begin]))
            for o, m in zip(out, made, strict=True):
                o.append(m)
            begin = end
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=names)

    return dealt.select(group, "c1", "c2", *columns).mapInArrow(run, schema)


def chunk_count(n: str, grams_total: str | None = None):
    by_count = F.ceil(F.col(n) / F.lit(CHUNK))
    most = F.greatest(by_count, F.ceil(F.col(grams_total) / F.lit(CHUNK_GRAMS))) if grams_total else by_count
    return most.cast("long").alias("chunks")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that span what pruned comparison connects; ``sets`` has id, sig, bands, one row for each n-gram set."""
    in_bands = sets.select("id", F.explode("bands").alias("band"))
    # bands whose buckets hold the same texts say the same; two texts are told exactly, more by 128 bits besides their ends
    who = [F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")]
    buckets = (
        in_bands.groupBy("band")
        .agg(F.count("*").alias("n"), *who)
        .filter("n > 1")
        .groupBy("n", "low", "high", "x", "y")
        .agg(F.min("band").alias("band"))
        .select("band", chunk_count("n"))
    )
    members = in_bands.join(buckets, "band").join(sets.select("id", "sig"), "id")
    fewest = fewest_agreements()

    def work(rows: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        ids = rows["id"]
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, VALUES)
        side, n = rows["side"], len(ids)
        first, second = likely_pairs(sigs, *pairs_within(side, same), fewest)
        own = np.arange(n)
        if not same:
            # what a chunk connects by itself comes from its own task: here only edges between such parts are new
            halves = [np.flatnonzero(side == s) for s in (0, 1)]
            inner = [likely_pairs(sigs, *(h[x] for x in np.triu_indices(len(h), 1)), fewest) for h in halves]
            own = spanning(n, *(np.concatenate(x) for x in zip(*inner, strict=True)))
        root = spanning(n, np.concatenate([first, np.arange(n)]), np.concatenate([second, own]))
        at = np.unique(own)
        at = at[root[at] != at]
        return ids[at], ids[root[at]]

    return by_chunk_pair(in_chunk_pairs(members, "band", "chunks"), "band", ["id", "side", "sig"], work, "a long, b long")


def verified(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact links within candidate groups: (id, links, root) parts, one for each pair of chunks a text is in.

    ``texts``: id, size, text; ``groups``: node, root.
    """
    sized = groups.join(texts.select(F.col("id").alias("node"), "size"), "node")
    chunks = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).select("root", chunk_count("n", "grams"))
    members = groups.join(chunks, "root").select(F.col("node").alias("id"), F.col("root").alias("grp"), "chunks")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_store()
        hashes = TokenHashes(word_hash)
        for batch in by_bytes(batches, 3):
            sets = [grams(t, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "grp", "chunks")] + [pa.array(sets, pa.binary())], names=["id", "grp", "chunks", "grams"]
            )

    held = texts.join(members, "id").select("id", "grp", "chunks", "text")
    held = held.mapInArrow(with_sets, "id long, grp long, chunks long, grams binary")

    def work(rows: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sets = rows["id"], [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        size = np.array([len(s) for s in sets], np.float64)
        shared = shared_grams(sets)
        linked = shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-9
        if not same:
            linked &= rows["side"][:, None] != rows["side"][None, :]
        np.fill_diagonal(linked, False)
        root = spanning(len(ids), *np.nonzero(np.triu(linked)))
        return ids, linked.sum(axis=1), ids[root]

    return by_chunk_pair(in_chunk_pairs(held, "grp", "chunks"), "grp", ["id", "side", "grams"], work, "id long, links long, root long")


def classes(rows: DataFrame) -> DataFrame:
    """For each distinct n-gram set of ``rows`` (from ``signed``): digest, first row, class, links, copies."""
    sets = rows.filter("size > 0").groupBy("digest").agg(
        F.min("row_id").alias("id"), F.min("key").alias("least_key"), F.count("*").alias("copies")
    )
    sets = staged(sets, "sets")
    firsts = rows.join(sets.select(F.col("id").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "id")
    groups = components(candidate_edges(firsts.select("id", "sig", "bands")))
    found = staged(verified(firsts.select("id", "size", "text"), groups), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = (
        sets.join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("digest", "id", "least_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    )
    placed = staged(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least_key").alias("class_id"))
    return placed.join(least, "root").select("digest", "id", "root", "class_id", "links", "copies")


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, class_id, n_links (other texts at the threshold or above), n_copies (same n-grams)."""
    rows = signed(docs, key, text)
    placed = rows.select("key", "digest").join(classes(rows).select("digest", "class_id", "links", "copies"), "digest", "left")
    return placed.select(
        F.col("key").alias(key),
        F.when(F.col("links").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class its first row stays; texts without n-grams all stay."""
    rows = signed(docs, key, text, carry=True)
    firsts = classes(rows).select(F.col("root").alias("row_id")).distinct()
    columns = [F.col({key: "key", text: "text"}[c]).alias(c) if c in (key, text) else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    kept = rows.filter("size > 0").join(firsts, "row_id", "left_semi").select(*columns)
    return kept.unionByName(rows.filter("size = 0").select(*columns))
