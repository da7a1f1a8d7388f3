"""Spelling variants, centroid clustering and sharding against brute force; edge rows for each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskweave.llm import centroid_clustering, sharding, spelling
from riskweave.llm.batches import by_bytes
from riskweave.llm.tables import table

DOC = "doc_id long, text string, source string, word string, n long, shard int, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    texts = [
        (1, "harvest harvets harvest Harvest harvest harvester"), (1, "harvest harvets harvest Harvest harvest harvester"), (2, ""),
        (3, None), (None, "harvets garden gardens garden"), (None, None), (4, "x" * 30000 + " " + "x" * 29999 + " garden"),
        (5, "ÀÉÎõü àÉÎõü ÀÉÎõü garden naïveté naïvete"), (6, "ÀÉÎõü " * 3 + "naïveté " * 4 + "x" * 30000), (7, "x" * 30000), (8, " \n\t "),
    ]
    return spark.createDataFrame([(i, t, None, "w", None, 3, "s") for i, t in texts], DOC).repartition(3).persist()


# ---- 11 ----


def edits(word, letters):
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            if c != word[i]:
                yield word[:i] + c + word[i + 1 :]
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]


def brute_variants(docs, longest=100):
    count = Counter()
    for key, text in docs:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    letters = sorted(set("".join(w for w in n if len(w) < longest)))
    near = {w: {e for e in edits(w, letters) if e in n and e != w} if len(w) < longest else set() for w in n}
    for a in n:
        for b in n:
            if len(a) >= longest and a != b and abs(len(a) - len(b)) <= 1 and set(a) == set(b) == {"x"}:
                near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_match_brute_force_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = [tuple(r) for r in entry.queries()["op11_spelling_variants"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == brute_variants(docs)
    assert any(f for _, f, *_ in got) and len(got) == len({w for w, *_ in got})


def test_variants_on_odd_rows_and_small_blocks(spark, odd, monkeypatch):
    want = brute_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert {"harvets", "naïveté", "x" * 30000} <= {w for w, *_ in want}
    for chunk, meet in ((2048, 8192), (2, 1)):
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        monkeypatch.setattr(spelling, "MEET", meet)
        assert sorted((tuple(r) for r in spelling.variants(odd).collect()), key=str) == want
    assert spelling.variants(odd.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    text = " ".join(" ".join([w] * 3 * 2**i) for i, w in enumerate(chain))
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), slip=None).collect()}
    assert [got[w].form for w in chain] == [*chain[1:], None] and {r.root for r in got.values()} == {"bbbbc"}


def test_near_pairs_of_random_words():
    r = random.Random(2)
    found = list({"".join(r.choice("abcÀé") for _ in range(r.randint(5, 8))) for _ in range(900)})
    block = spelling.Block(found, [1] * len(found))
    got = {(found[i], found[j]) for i, j in zip(*spelling.near_pairs(block, block), strict=True)}
    here = set(found)
    assert got == {(w, e) for w in found for e in edits(w, "abcÀé") if e in here and e != w}


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * 5, None, "", "é" * 10, "b" * 100, "c"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["i", "t"])
    cut = list(by_bytes([batch, batch.slice(0, 0)], 1, 30))
    assert [x for b in cut for x in b.column(1).to_pylist()] == texts and len(cut) > 5
    assert all(sum(len((t or "").encode()) for t in b.column(1).to_pylist()) < 30 + 100 for b in cut)


# ---- 12 ----


def brute_clusters(rows, k=16, rounds=3, dim=64, scale=64, seed=1):
    held = [(i, [math.floor(scale * float(x)) if abs(x) < 2**50 else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in start[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [min((gap(v, c), j) for j, c in enumerate(at)) for _, v in held]

    for _ in range(rounds):
        to = nearest()
        for j in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(held, to, strict=True) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to = nearest()
    fit = lambda x: x if x < 2**63 else None
    each = [sum(d for d, c in to if c == j) for j in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, fit(d), fit(each[c]), fit(sum(each)), digest[c]) for (i, _), (d, c) in zip(held, to, strict=True)), key=str)


def clusters(frame, **options):
    return sorted((tuple(r) for r in centroid_clustering.cluster(frame, **options).collect()), key=str)


def test_clusters_match_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = sorted((tuple(r) for r in entry.queries()["op12_centroid_clustering"](spark, sf_dir).collect()), key=str)
    assert got == brute_clusters(rows)


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_on_odd_vectors(spark, huge):
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-3, 4, 6) / 64).tolist(), "x") for i in range(200)]  # many ties
    rows += [(i, [0.5] * 6, "x") for i in (300, 300, 301)] + [(None, [0.25] * 6, "x"), (302, [0.0] * 6, "x")]
    rows += [(400, None, "x"), (401, [], "x"), (402, [float("nan")] * 6, "x"), (403, [None] + [0.5] * 5, "x"), (404, [float("inf")] * 6, "x"), (405, [0.1] * 7, "x")]
    rows += [(500, [1e9, -1e9] * 3, "x"), (501, [1e200, 5.5, -1e200, 0.0, 3e7, 1e15], "x")] if huge else []
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(4)
    for k in (1, 5, 16):
        assert clusters(frame, k=k, dim=6) == brute_clusters([x[:2] for x in rows], k=k, dim=6)
    few = frame.filter("vec_id < 3")
    assert clusters(few, dim=6) == brute_clusters([x[:2] for x in rows if x[0] is not None and x[0] < 3], dim=6)
    assert clusters(frame.limit(0), dim=6) == [] and centroid_clustering.cluster(frame.limit(0)).columns == centroid_clustering.cluster(few, dim=6).columns


def test_orchard_search_measures_few_and_loses_no_tie():
    r = np.random.default_rng(5)
    at = r.integers(-4, 5, (60, 3))
    rows = r.integers(-5, 6, (3000, 3))
    every = ((rows[:, None] - at[None]) ** 2).sum(axis=2)
    cluster, distance = centroid_clustering.Centroids.of(at).nearest(rows)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


# ---- 13 ----


def check_shards(rows, docs, shards):
    assert Counter(r[:2] for r in rows) == Counter(docs)
    by = {}
    for *_, s, slot in rows:
        by.setdefault(s, []).append(slot)
    assert sorted((len(by.get(s, [])) for s in range(shards)), reverse=True) == sharding.even_sizes(len(docs), shards)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))


def test_shards_of_documents(spark, sf_dir):
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf_dir, "documents").collect()]
    found = entry.queries()["op13_hypergeometric_sharding"](spark, sf_dir).collect()
    want = Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want and {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in found], [(i, len(t) + 1) for i, t in docs], 16)
    again = entry.queries()["op13_hypergeometric_sharding"](spark, sf_dir).collect()
    assert Counter(found) == Counter(again)


def test_shards_on_odd_rows(spark, odd, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for rows_of_range in (4096, 1):
        monkeypatch.setattr(sharding, "RANGE_ROWS", rows_of_range)
        for shards in (1, 3, 20):
            done = sharding.shuffled(odd, shards)
            assert done.columns == [*odd.columns, "shard_", "slot_"]
            check_shards([(r.doc_id, r.text, r.shard_, r.slot_) for r in done.collect()], docs, shards)
    assert sharding.shuffled(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffled(odd, 0)


def test_matrix_adds_up_and_follows_the_distribution():
    blocks, sizes = [7, 0, 3, 10, 1], [6, 6, 5, 4]
    cells = Counter()
    for seed in range(4000):
        m = sharding.communication_matrix(blocks, sizes, seed)
        assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
        cells[int(m[0, 1])] += 1
    for x in range(7):
        p = math.comb(6, x) * math.comb(15, 7 - x) / math.comb(21, 7)
        assert abs(cells[x] / 4000 - p) < 4 * (p * (1 - p) / 4000) ** 0.5 + 1e-9


def test_hypergeometric_draws_of_any_size():
    rng = np.random.default_rng(1)
    small = [sharding.hypergeometric(rng, 50, 150, 40) for _ in range(4000)]
    assert abs(np.mean(small) - 10) < 0.15 and abs(np.var(small) - 40 * 0.25 * 0.75 * 160 / 199) < 0.5
    large = [sharding.hypergeometric(rng, 2 * 10**9, 30 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(large) - 62500) < 60 and abs(np.std(large) - 242) < 40
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 5, 10) == 5


def test_every_order_is_equally_likely(spark):
    """Which row comes first in shard 0, over seeds."""
    rows = spark.range(6).repartition(3).persist()
    first = Counter(sharding.shuffled(rows, 2, seed).filter("shard = 0 AND slot = 0").first().id for seed in range(60))
    assert len(first) == 6 and max(first.values()) < 25


def test_equal_rows_spread_over_shards(spark):
    rows = spark.range(3000).select(F.lit("same").alias("text"))
    assert {r["count"] for r in sharding.shuffled(rows, 16).groupBy("shard").count().collect()} == {187, 188}
