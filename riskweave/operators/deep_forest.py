"""Forests of unlimited depth: large nodes are split by distributed counts, small ones are grown to the end where their rows meet.

Spark's learner keeps dense counts for every node of a level and sends them from every partition, whatever the node holds.  Near
the leaves that is far more than the rows themselves.  Here rows are binned once; a node with more than ``SMALL_NODE`` rows of its
bootstrap is split by counts that the partitions add up; the rows of a smaller one are sent to one task, which holds at most
that many, and grown until they are pure.  Where all rows fit a task, each task grows whole trees in the same way.  Bootstrap counts are hashed from row and tree, so both phases see the same draw.  The
result is Spark's own forest model: its node table is written in the saved form and loaded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.scratch import scratch_path, spread, staged

SMALL_NODE = 131_072  # rows of its bootstrap that a node may have to be grown in one task
HELD = 6_291_456  # rows that a task holds to grow whole trees, at a byte for each feature and some 20 more
SUBTREE = 32_768  # the same where the task holds all rows anyway; of few rows, less memory is touched at once
NODES_AT_ONCE = 4_096  # nodes that one counting job covers
ROWS_AT_ONCE = 65_536  # rows that a task handles in one step
ROWS_OF_SUMMARY = 131_072  # rows whose values are summed up together for the cuts
TINY = 1e-15  # a gain below is rounding

SPLIT = "tree int, node long, feature int, cut int, gain double, l0 long, l1 long, r0 long, r1 long"
ROWS = "tree int, node long, n int, bins binary, codes binary"
GROWN = "tree int, node long, place int, left int, right int, feature int, limit double, gain double, n0 long, n1 long"
NODES = "tree int, id int, left int, right int, feature int, limit double, gain double, n0 long, n1 long"


def features_drawn(share: str, width: int) -> int:
    """How many features a node looks at, for Spark's names and for a share."""
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
    return named[share] if share in named else max(1, min(width, math.ceil(float(share) * width)))


@dataclass
class Rules:
    """What growing depends on besides the rows."""

    trees: int
    depth: int
    drawn: int
    width: int
    cuts: list[np.ndarray]
    bins: int
    least: int
    classes: tuple[int, int]  # rows of each
    weights: tuple[float, float]
    seed: int
    bootstrap: bool = True

    def limits(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """What the values of each node are compared with; 0 for a leaf, whose feature is -1."""
        wide = np.array([np.pad(c, (0, self.bins - len(c))) for c in self.cuts])
        return np.where(feature < 0, 0.0, wide[feature, cut])


# ---- cuts and binned rows ----


def cuts_of(frame: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each entry of ``values``: between all values if they are few, else at quantiles.

    One pass: a task sorts some ``ROWS_OF_SUMMARY`` rows at a time and hands on the values of each entry, or ``4 * bins`` evenly spaced
    ones if they are many, with the rows that each stands for; a rank is off by at most one in ``8 * bins``.
    """
    most = 4 * bins

    def summaries(rows: np.ndarray) -> pa.RecordBatch:
        out = []
        for i in range(width):
            v = np.sort(rows[:, i])
            v = v[: np.searchsorted(v, np.nan)]  # missing values are last
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
            few = len(first) <= bins
            if few:
                value, stands = v[first], np.diff(first, append=len(v))
            else:
                ends = len(v) * np.arange(min(most, len(v)) + 1) // min(most, len(v))
                value, stands = np.r_[v[0], v[(ends[1:] + ends[:-1]) // 2], v[-1]], np.r_[0, np.diff(ends), 0]
            out.append((i, few, value.tobytes(), stands.astype(np.int64).tobytes()))
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["entry", "few", "held", "stands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                n += batch.num_rows
            if n >= ROWS_OF_SUMMARY:
                yield summaries(np.concatenate(held))
                held, n = [], 0
        if n:
            yield summaries(np.concatenate(held))

    found = frame.select("values").mapInArrow(run, "entry int, few boolean, held binary, stands binary").collect()  # a row for each entry of a summary
    out = []
    for i in range(width):
        own = [r for r in found if r["entry"] == i]
        value = np.concatenate([np.empty(0), *(np.frombuffer(r["held"]) for r in own)])
        seen = np.unique(value)
        if all(r["few"] for r in own) and len(seen) <= bins:
            out.append((seen[1:] + seen[:-1]) / 2)
            continue
        order = np.argsort(value, kind="stable")
        upto = np.cumsum(np.concatenate([np.frombuffer(r["stands"], np.int64) for r in own])[order])
        ranks = upto[-1] * np.arange(1, bins) / bins
        at = np.r_[seen[0], value[order][np.searchsorted(upto, ranks)], seen[-1]]
        out.append(np.unique(at)[:-1][: bins - 1])
    return out


def binned(frame: DataFrame, label: str, cuts: list[np.ndarray], bins: int) -> DataFrame:
    """(row, bins, label): a row's bins in one byte each (two, if there are more than 256).  A missing value is in the last bin."""
    kind = np.uint8 if bins <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            made = np.empty(x.shape, kind)
            for i, cut in enumerate(cuts):
                made[:, i] = np.searchsorted(cut, x[:, i], side="left")
            size = made.shape[1] * made.itemsize
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(made), [None, pa.py_buffer(made.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), blob.cast(pa.binary()), batch.column("label")], ["row", "bins", "label"])

    rows = frame.select("row", "values", F.col(label).cast("int").alias("label"))  # a row keeps the number that it was stored with
    return rows.mapInArrow(run, "row long, bins binary, label int")


def _blocks(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bins, labels) of about ``ROWS_AT_ONCE`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield _block(held, rules)
            held, n = [], 0
    if n:
        yield _block(held, rules)


def _matrix(blobs: list[bytes], rules: Rules) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8 if rules.bins <= 256 else np.uint16).reshape(-1, rules.width)


def _block(held: list[pa.RecordBatch], rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held)
    return table.column("row").to_numpy(), _matrix(table.column("bins").to_pylist(), rules), table.column("label").to_numpy()


POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])


def draws(rows: np.ndarray, tree: int, rules: Rules) -> np.ndarray:
    """How often each row is in the bootstrap of a tree: Poisson with mean 1, from a hash of row and tree."""
    if not rules.bootstrap:
        return np.ones(len(rows), np.uint8)
    start = np.random.SeedSequence([rules.seed & 0xFFFFFFFF, tree]).generate_state(1, np.uint64)[0]
    z = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + start
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


# ---- the best split of a node ----


def gini(n0, n1, weights):
    a, b = n0 * weights[0], n1 * weights[1]
    total = np.maximum(a + b, 1e-300)
    return 2 * (a / total) * (b / total)


def gains(l0, l1, t0, t1, rules: Rules) -> np.ndarray:
    """Fall of the impurity when l0 and l1 of a node's t0 and t1 rows of the classes go left; -1 where it may not be split so."""
    w = rules.weights
    r0, r1 = t0 - l0, t1 - l1
    left, all_ = l0 * w[0] + l1 * w[1], t0 * w[0] + t1 * w[1]
    fall = gini(t0, t1, w) - (left * gini(l0, l1, w) + (all_ - left) * gini(r0, r1, w)) / all_
    return np.where((l0 + l1 >= rules.least) & (r0 + r1 >= rules.least), fall, -1.0)


def node_features(tree: int, node: int, rules: Rules) -> np.ndarray:
    """The features that a large node looks at."""
    return np.sort(np.random.default_rng([rules.seed & 0xFFFFFFFF, tree, node]).permutation(rules.width)[: rules.drawn])


# ---- large nodes ----


@dataclass
class Top:
    """The upper nodes of a tree, numbered as found; a node without children is open, a leaf or the root of a small subtree."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    counts: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    level: list[int] = field(default_factory=lambda: [0])

    def child(self, parent: int, n0: int, n1: int) -> int:
        for values, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.gain, -1.0)):
            values.append(x)
        self.counts.append((n0, n1))
        self.level.append(self.level[parent] + 1)
        return len(self.feature) - 1

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The node each row falls in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        rows = np.arange(len(bins))
        for _ in range(max(self.level)):
            inner = left[at] >= 0
            small = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(small, left[at], right[at]), at)
        return at


def _counted(rows: DataFrame, tops: dict[int, Top], wanted: dict[int, list[int]], rules: Rules) -> DataFrame:
    """(tree, node, counts) of each block of rows: integers by drawn feature, bin and class."""
    cells = rules.drawn * rules.bins * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {t: np.zeros(len(nodes) * cells, np.int64) for t, nodes in wanted.items()}
        drawn = {t: np.array([node_features(t, n, rules) for n in nodes]) for t, nodes in wanted.items()}
        for ids, bins, label in _blocks(batches, rules):
            for t, nodes in wanted.items():
                count = draws(ids, t, rules)
                place = np.full(len(tops[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[tops[t].reached(bins)]
                kept = np.flatnonzero((at >= 0) & (count > 0))
                at, b = at[kept], np.take_along_axis(bins[kept], drawn[t][at[kept]], axis=1).astype(np.int64)
                key = ((at[:, None] * rules.drawn + np.arange(rules.drawn)) * rules.bins + b) * 2 + label[kept, None]
                times = np.repeat(count[kept].astype(float), rules.drawn)
                total[t] += np.bincount(key.reshape(-1), times, len(total[t])).astype(np.int64)
        for t, nodes in wanted.items():
            blobs = [c.tobytes() for c in total[t].reshape(len(nodes), cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["tree", "node", "counts"]
            )

    return rows.mapInArrow(run, "tree int, node long, counts binary")


def _best_splits(counted: DataFrame, rules: Rules) -> DataFrame:
    def best(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        counts = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()).reshape(rules.drawn, rules.bins, 2)
        left = counts.cumsum(axis=1)[:, :-1]
        t0, t1 = (int(x) for x in counts[0].sum(axis=0))
        fall = gains(left[:, :, 0], left[:, :, 1], t0, t1, rules)
        j, cut = np.unravel_index(int(fall.argmax()), fall.shape)
        l0, l1 = (int(x) for x in left[j, cut])
        row = [tree, node, int(node_features(tree, node, rules)[j]), int(cut), float(fall[j, cut]), l0, l1, t0 - l0, t1 - l1]
        names = ["tree", "node", "feature", "cut", "gain", "l0", "l1", "r0", "r1"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return counted.groupBy("tree", "node").applyInArrow(best, SPLIT)


def large_nodes(rows: DataFrame, n: int, rules: Rules, small: int) -> tuple[dict[int, Top], dict[int, list[int]]]:
    """The upper trees, and which of their nodes are small enough to be grown in one task."""
    tops = {t: Top() for t in range(rules.trees)}
    waiting: dict[int, list[int]] = {t: [] for t in tops}
    opened = [(t, 0) for t in tops]
    if n <= small or not rules.depth:
        return tops, {t: [0] for t in tops}
    while opened:
        later = []
        for s in range(0, len(opened), NODES_AT_ONCE):
            wanted: dict[int, list[int]] = {}
            for t, node in opened[s : s + NODES_AT_ONCE]:
                wanted.setdefault(t, []).append(node)
            for r in _best_splits(_counted(rows, tops, wanted, rules), rules).collect():  # one row a node
                top, node = tops[r["tree"]], r["node"]
                top.counts[node] = (r["l0"] + r["r0"], r["l1"] + r["r1"])
                if r["gain"] <= TINY:
                    continue
                top.feature[node], top.cut[node], top.gain[node] = r["feature"], r["cut"], r["gain"]
                top.left[node], top.right[node] = top.child(node, r["l0"], r["l1"]), top.child(node, r["r0"], r["r1"])
                for c in (top.left[node], top.right[node]):
                    if all(top.counts[c]) and top.level[c] < rules.depth:
                        (later.append((r["tree"], c)) if sum(top.counts[c]) > small else waiting[r["tree"]].append(c))
        opened = later
    return tops, waiting


# ---- small nodes ----


def _sent(rows: DataFrame, tops: dict[int, Top], waiting: dict[int, list[int]], rules: Rules) -> DataFrame:
    """(tree, node, n, bins, codes): the bootstrap rows of small nodes; a code is twice the row's count plus its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bins, label in _blocks(batches, rules):
            for t, nodes in waiting.items():
                if not nodes:
                    continue
                count, asked = draws(ids, t, rules), np.zeros(len(tops[t].feature), bool)
                asked[nodes] = True
                at = tops[t].reached(bins)
                kept = np.flatnonzero(asked[at] & (count > 0))
                kept = kept[np.argsort(at[kept], kind="stable")]
                ends = np.flatnonzero(np.diff(at[kept], append=-1)) + 1
                parts = np.split(kept, ends[:-1]) if len(ends) else []
                codes = (count * 2 + label).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t] * len(parts), pa.int32()),
                        pa.array([int(at[p[0]]) for p in parts], pa.int64()),
                        pa.array([len(p) for p in parts], pa.int32()),
                        pa.array([bins[p].tobytes() for p in parts], pa.binary()),
                        pa.array([codes[p].tobytes() for p in parts], pa.binary()),
                    ],
                    ["tree", "node", "n", "bins", "codes"],
                )

    return rows.mapInArrow(run, ROWS)


def _best_of_counts(value: np.ndarray, label: np.ndarray, count: np.ndarray, pos: np.ndarray, t0: np.ndarray, t1: np.ndarray, rules: Rules):
    """Gain, drawn feature and cut of the first best cut of each node, by counts of every bin: for nodes of many rows."""
    nodes, m = len(t0), value.shape[1]
    key = (((pos[:, None] * m + np.arange(m)) * rules.bins + value) * 2 + label[:, None]).reshape(-1)
    counts = np.bincount(key, np.repeat(count.astype(float), m), nodes * m * rules.bins * 2).reshape(nodes, m, rules.bins, 2)
    left = counts.cumsum(axis=2)[:, :, :-1]
    fall = gains(left[..., 0], left[..., 1], t0[:, None, None], t1[:, None, None], rules).reshape(nodes, -1)
    best = fall.argmax(axis=1)
    return fall[np.arange(nodes), best], best // (rules.bins - 1), best % (rules.bins - 1)


def subtree(bins: np.ndarray, label: np.ndarray, count: np.ndarray, depth: int, rules: Rules, seed: list[int]) -> dict[str, np.ndarray]:
    """All nodes below (and with) one node; children come after their parent, and leaves of one class are joined."""
    return joined(unjoined(bins, label, count, depth, rules, seed), rules)


def unjoined(bins: np.ndarray, label: np.ndarray, count: np.ndarray, depth: int, rules: Rules, seed: list[int]) -> dict[str, np.ndarray]:
    """The nodes of ``subtree`` as they are found, a level at a time."""
    rng, m, count = np.random.default_rng(seed), rules.drawn, count.astype(np.int64)
    n0, n1 = [np.array([count[label == 0].sum()])], [np.array([count[label == 1].sum()])]
    made = {k: [] for k in ("at", "feature", "cut", "gain", "left")}
    nodes, total = np.array([0]), 1  # open nodes of this level
    rows, pos = np.arange(len(label)), np.zeros(len(label), np.int64)
    t0, t1 = n0[0], n1[0]
    for _ in range(depth):
        if not len(nodes) or not len(rows):
            break
        drawn = np.argpartition(rng.random((len(nodes), rules.width)), m - 1, axis=1)[:, :m] if m < rules.width else np.tile(np.arange(m), (len(nodes), 1))
        drawn = np.sort(drawn, axis=1)
        value = bins[rows[:, None], drawn[pos]].astype(np.int64)
        if len(nodes) * rules.bins <= len(rows):
            top, which, at_cut = _best_of_counts(value, label[rows], count[rows], pos, t0, t1, rules)
            split = np.flatnonzero(top > TINY)
            best, feature, cut = top[split], drawn[split, which[split]], at_cut[split]
        else:
            key = (((pos[:, None] * m + np.arange(m)) * rules.bins + value) << 32) + np.arange(len(rows))[:, None]
            key = np.sort(key.reshape(-1))
            who, key = key & 0xFFFFFFFF, key >> 32
            last = np.flatnonzero(np.diff(key, append=-1))  # the last row of each bin that occurs
            group = key[last] // rules.bins
            c, y = count[rows[who]], label[rows[who]]
            c0, c1 = np.cumsum(c * (y == 0))[last], np.cumsum(c * (y == 1))[last]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            width = np.diff(first, append=len(group))
            before0, before1 = (np.repeat(np.where(first > 0, x[first - 1], 0), width) for x in (c0, c1))
            node = group // m
            fall = gains(c0 - before0, c1 - before1, t0[node], t1[node], rules)
            starts = np.flatnonzero(np.diff(node, prepend=-1))
            top = np.maximum.reduceat(fall, starts)
            hit = np.flatnonzero(fall == np.repeat(top, np.diff(starts, append=len(node))))
            hit = hit[np.flatnonzero(np.diff(node[hit], prepend=-1))]  # the first best cut of each node
            hit = hit[fall[hit] > TINY]
            split = node[hit]
            best, feature, cut = fall[hit], drawn[split, group[hit] % m], key[last[hit]] % rules.bins
        if not len(split):
            break
        child = total + 2 * np.arange(len(split))
        for k, v in (("at", nodes[split]), ("feature", feature), ("cut", cut), ("gain", best), ("left", child)):
            made[k].append(v)
        order = np.full(len(nodes), -1)
        order[split] = np.arange(len(split))
        own = order[pos]
        rows, own = rows[own >= 0], own[own >= 0]
        side = 2 * own + (bins[rows, feature[own]] > cut[own])
        s0, s1 = (np.bincount(side, count[rows] * (label[rows] == k), 2 * len(split)).astype(np.int64) for k in (0, 1))
        n0.append(s0)
        n1.append(s1)
        alive = (s0 > 0) & (s1 > 0)
        place = np.cumsum(alive) - 1
        kept = alive[side]
        rows, pos = rows[kept], place[side[kept]]
        nodes, t0, t1 = total + np.flatnonzero(alive), s0[alive], s1[alive]
        total += 2 * len(split)
    flat = {k: np.concatenate(v) if v else np.empty(0) for k, v in made.items()}
    at = flat["at"].astype(np.int64)
    out = {"left": np.full(total, -1), "right": np.full(total, -1), "feature": np.full(total, -1), "cut": np.zeros(total, np.int64), "gain": np.full(total, -1.0)}
    out["left"][at], out["right"][at] = flat["left"], flat["left"] + 1
    out["feature"][at], out["cut"][at], out["gain"][at] = flat["feature"], flat["cut"], flat["gain"]
    return {**out, "n0": np.concatenate(n0), "n1": np.concatenate(n1)}


def joined(t: dict[str, np.ndarray], rules: Rules) -> dict[str, np.ndarray]:
    """A tree whose sibling leaves of one class are one leaf, as Spark joins them, without the nodes that this leaves over."""
    vote, n = t["n1"] * rules.weights[1] > t["n0"] * rules.weights[0], len(t["left"])
    left, leaf = t["left"], t["left"] < 0
    inner = np.flatnonzero(~leaf)
    while len(inner):
        a, b = left[inner], t["right"][inner]
        same = leaf[a] & leaf[b] & (vote[a] == vote[b])
        if not same.any():
            break
        leaf[inner[same]] = True
        inner = inner[~same]
    kept = np.zeros(n, bool)
    level = np.array([0])
    while len(level):
        kept[level] = True
        level = level[~leaf[level]]
        level = np.concatenate([left[level], t["right"][level]])
    place = np.cumsum(kept) - 1
    out = {k: v[kept].copy() for k, v in t.items()}
    end = leaf[kept]
    for k in ("left", "right"):
        out[k] = np.where(end, -1, place[np.maximum(out[k], 0)])
    out["feature"][end], out["cut"][end], out["gain"][end] = -1, 0, -1.0
    return out


def _grown(sent: DataFrame, levels: dict[tuple[int, int], int], rules: Rules) -> DataFrame:
    def grow(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        bins = _matrix(table.column("bins").to_pylist(), rules)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8)
        found = subtree(bins, codes & 1, codes >> 1, rules.depth - levels[tree, node], rules, [rules.seed & 0xFFFFFFFF, tree, node, 1])
        found["limit"] = rules.limits(found["feature"], found["cut"])
        kinds = {"left": pa.int32(), "right": pa.int32(), "feature": pa.int32(), "limit": pa.float64(), "gain": pa.float64(), "n0": pa.int64(), "n1": pa.int64()}
        size, columns = len(found["left"]), [pa.array(found[k], kind) for k, kind in kinds.items()]
        head = [pa.array(np.full(size, tree), pa.int32()), pa.array(np.full(size, node), pa.int64()), pa.array(np.arange(size), pa.int32())]
        return pa.Table.from_arrays([*head, *columns], ["tree", "node", "place", *kinds])

    cores = sent.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * cores, len(levels) // 16)
    return sent.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grow, GROWN)


# ---- whole trees in a task ----


def whole_tree(rows: np.ndarray, bins: np.ndarray, label: np.ndarray, tree: int, rules: Rules, small: int) -> dict[str, np.ndarray]:
    """A tree from all rows; ``bins`` by [feature, row].  Large nodes are split by counts, smaller ones as subtrees."""
    count = draws(rows, tree, rules)
    made = {"left": [-1], "right": [-1], "feature": [-1], "cut": [0], "gain": [-1.0], "n0": [0], "n1": [0]}
    below: list[tuple[int, dict[str, np.ndarray]]] = []  # what grows at a node
    waiting = [(0, 0, np.flatnonzero(count).astype(np.int32))]
    while waiting:
        node, level, at = waiting.pop()
        c, y = count.take(at), label.take(at)
        n1 = int(c[y == 1].sum(dtype=np.int64))
        n0 = int(c.sum(dtype=np.int64)) - n1
        made["n0"][node], made["n1"][node] = n0, n1
        if not n0 or not n1 or level >= rules.depth:
            continue
        if n0 + n1 <= min(small, SUBTREE):
            seed = [rules.seed & 0xFFFFFFFF, tree, node, 1]
            below.append((node, unjoined(np.ascontiguousarray(bins[:, at].T), y, c, rules.depth - level, rules, seed)))
            continue
        drawn = node_features(tree, node, rules)
        counts = np.zeros((len(drawn), rules.bins * 2))
        for s in range(0, len(at), ROWS_AT_ONCE):
            part, times, own = at[s : s + ROWS_AT_ONCE].astype(np.intp), c[s : s + ROWS_AT_ONCE].astype(float), y[s : s + ROWS_AT_ONCE].astype(np.intp)
            for j, f in enumerate(drawn):
                counts[j] += np.bincount(bins[f].take(part).astype(np.intp) * 2 + own, times, counts.shape[1])
        left = counts.reshape(len(drawn), rules.bins, 2).cumsum(axis=1)[:, :-1]
        fall = gains(left[:, :, 0], left[:, :, 1], n0, n1, rules)
        j, cut = np.unravel_index(int(fall.argmax()), fall.shape)
        if fall[j, cut] <= TINY:
            continue
        made["feature"][node], made["cut"][node], made["gain"][node] = int(drawn[j]), int(cut), float(fall[j, cut])
        goes_left = bins[drawn[j]].take(at) <= cut
        for side, part in (("left", at[goes_left]), ("right", at[~goes_left])):
            made[side][node] = len(made["left"])
            for k, none in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0), ("gain", -1.0), ("n0", 0), ("n1", 0)):
                made[k].append(none)
            waiting.append((made[side][node], level + 1, part))
    out = {k: [np.array(v)] for k, v in made.items()}
    size = len(made["left"])
    for node, found in below:
        moved = {k: np.where(found[k] < 0, -1, found[k] + size - 1) for k in ("left", "right")}  # its root is the node itself
        found = {**found, **moved}
        for k in out:
            out[k][0][node] = found[k][0]
            out[k].append(found[k][1:])
        size += len(found["left"]) - 1
    return joined({k: np.concatenate(v) for k, v in out.items()}, rules)


def _packed(rows: DataFrame, rules: Rules) -> DataFrame:
    """(rows, bins, labels) of some ``ROWS_AT_ONCE`` rows, as they lie; bins by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bins, label in _blocks(batches, rules):
            parts = (ids.tobytes(), np.ascontiguousarray(bins.T).tobytes(), label.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["rows", "bins", "labels"])

    return rows.mapInArrow(run, "rows binary, bins binary, labels binary")


def whole_trees(rows: DataFrame, rules: Rules, small: int = SMALL_NODE) -> DataFrame:
    """``grown`` by tasks that hold all rows each and grow some of the trees; nothing but the rows is shuffled."""
    spark = rows.sparkSession
    tasks = min(rules.trees, spark.sparkContext.defaultParallelism)
    # a key for each partition, so that no task gets two shares
    place = F.pmod(F.hash("id"), F.lit(tasks)).alias("place")
    keys = {r["place"]: r["key"] for r in spark.range(64 * tasks).groupBy(place).agg(F.min("id").alias("key")).collect()}
    first = {key: i for i, key in enumerate(keys.values())}
    kind = np.uint8 if rules.bins <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows else task
            for ids, bins, label in zip(*(batch.column(k).to_pylist() for k in ("rows", "bins", "labels")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                held.append((ids, np.frombuffer(bins, kind).reshape(rules.width, len(ids)), np.frombuffer(label, np.uint8)))
        if not held:
            return
        held.sort(key=lambda block: block[0][0])  # whatever the order in which blocks came
        ids, label = (np.concatenate([b[i] for b in held]) for i in (0, 2))
        bins, at = np.empty((rules.width, len(ids)), kind), 0
        while held:
            block = held.pop(0)[1]
            bins[:, at : at + block.shape[1]] = block
            at += block.shape[1]
        for t in range(first[task], rules.trees, len(first)):
            found = whole_tree(ids, bins, label, t, rules, small)
            size = len(found["left"])
            columns = [np.full(size, t), np.arange(size), found["left"], found["right"], found["feature"], rules.limits(found["feature"], found["cut"])]
            columns += [found["gain"], found["n0"], found["n1"]]
            kinds = [*[pa.int32()] * 5, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["tree", "id", "left", "right", "feature", "limit", "gain", "n0", "n1"]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names)

    dealt = _packed(rows, rules).select(F.explode(F.array(*[F.lit(k).cast("long") for k in first])).alias("task"), "rows", "bins", "labels")
    return staged(dealt.repartition(tasks, "task").mapInArrow(run, NODES), "nodes")


# ---- the model ----


def grown(rows: DataFrame, rules: Rules, small: int = SMALL_NODE) -> DataFrame:
    """(tree, id, left, right, feature, limit, gain, n0, n1): all nodes of the forest, stored; ids from 0 within a tree."""
    spark = rows.sparkSession
    tops, waiting = large_nodes(rows, sum(rules.classes), rules, small)
    levels = {(t, node): tops[t].level[node] for t, nodes in waiting.items() for node in nodes}
    below = staged(_grown(_sent(rows, tops, waiting, rules), levels, rules), "subtrees")
    root = F.max(F.when(F.col("place") == 0, F.struct("n0", "n1")))
    roots = {(r["tree"], r["node"]): r for r in below.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), root.alias("root")).collect()}
    upper, moved = [], []  # rows of the upper trees; where each subtree goes
    for t, top in tops.items():
        for node in waiting[t]:  # a bootstrap of very few rows can be empty
            top.counts[node] = tuple(roots[t, node]["root"]) if (t, node) in roots else rules.classes
        hold = [n for n in waiting[t] if (t, n) in roots and roots[t, n]["size"] > 1]
        tree = _upper(top, np.array(hold, int), rules)
        limit, held, end = rules.limits(tree["feature"], tree["cut"]), set(hold), len(tree["left"])
        for i, node in enumerate(tree["node"].tolist()):
            if node in held:
                moved.append((t, node, i, end))
                end += roots[t, node]["size"] - 1
            else:
                ints = [int(tree[k][i]) for k in ("left", "right", "feature")]
                upper.append((t, i, *ints, float(limit[i]), float(tree["gain"][i]), int(tree["n0"][i]), int(tree["n1"][i])))

    def number(c: str):
        at = F.col(c)
        return F.when(at > 0, F.col("start") + at - 1).when(at == 0, F.col("root")).otherwise(-1).cast("int").alias(c)

    lower = below.join(spark.createDataFrame(moved, "tree int, node long, root int, start int"), ["tree", "node"])
    lower = lower.select("tree", number("place"), number("left"), number("right"), "feature", "limit", "gain", "n0", "n1").withColumnRenamed("place", "id")
    return staged(lower.unionByName(spark.createDataFrame(upper, NODES)), "nodes")


def _upper(top: Top, hold: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The upper tree with sibling leaves of one class joined; nodes in ``hold`` have subtrees and stay.  ``node``: the number before."""
    size, counts = len(top.left), np.array([c or (0, 0) for c in top.counts])
    extra = size + np.arange(2 * len(hold))  # two children of different classes, so that nothing is joined there
    more = lambda v, x: np.concatenate([np.array(v), np.full(len(extra), x)])
    tree = {
        "left": more(top.left, -1), "right": more(top.right, -1), "feature": more(top.feature, -1), "cut": more(top.cut, 0),
        "gain": more(top.gain, -1.0), "n0": more(counts[:, 0], 0), "n1": more(counts[:, 1], 0), "node": np.arange(size + len(extra)),
    }
    tree["left"][hold], tree["right"][hold] = extra[::2], extra[1::2]
    tree["n0"][extra[::2]] = tree["n1"][extra[1::2]] = 1
    found = joined(tree, rules)
    real = {k: v[found["node"] < size] for k, v in found.items()}
    for k in ("left", "right"):  # the added children are the last
        real[k] = np.where(real[k] < len(real["node"]), real[k], -1)
    return real


def _saved(nodes: DataFrame, rules: Rules) -> DataFrame:
    """The node table as Spark's forest stores it."""
    w0, w1 = (F.col(f"n{k}") * F.lit(rules.weights[k]) for k in (0, 1))
    share, none = w0 / (w0 + w1), F.array().cast("array<double>")
    return nodes.select(
        F.col("tree").alias("treeID"),
        F.struct(
            F.col("id"),
            (w1 > w0).cast("double").alias("prediction"),
            (2 * share * (1 - share)).alias("impurity"),
            F.array(w0, w1).alias("impurityStats"),
            (F.col("n0") + F.col("n1")).alias("rawCount"),
            "gain",
            F.col("left").alias("leftChild"),
            F.col("right").alias("rightChild"),
            F.struct(
                F.col("feature").alias("featureIndex"),
                F.when(F.col("left") < 0, none).otherwise(F.array("limit")).alias("leftCategoriesOrThreshold"),
                F.lit(-1).alias("numCategories"),
            ).alias("split"),
        ).alias("nodeData"),
    )


def fit(frame: DataFrame, forest: RandomForestClassifier, small: int = SMALL_NODE) -> RandomForestClassificationModel:
    """``forest`` fitted on ``frame``; its weights must depend on the label only, as class weights do."""
    label, weight = forest.getLabelCol(), forest.getWeightCol()
    ends = F.min(weight).alias("lo"), F.max(weight).alias("hi"), F.count(F.lit(1)).alias("n")
    classes = {r["y"]: r for r in frame.groupBy(F.col(label).cast("int").alias("y")).agg(*ends).collect()}
    if set(classes) != {0, 1}:
        raise ValueError(f"need both labels 0 and 1, have {sorted(classes, key=str)}")
    if any(r["lo"] != r["hi"] for r in classes.values()):
        raise ValueError("weights must be equal within a class")
    values = staged(spread(frame).select(F.monotonically_increasing_id().alias("row"), vector_to_array(forest.getFeaturesCol()).alias("values"), label), "values")
    width, bins = values.select(F.size("values")).first()[0], forest.getMaxBins()
    rules = Rules(
        forest.getNumTrees(), forest.getMaxDepth(), features_drawn(forest.getFeatureSubsetStrategy(), width), width, cuts_of(values, width, bins),
        bins, forest.getMinInstancesPerNode(), (classes[0]["n"], classes[1]["n"]), (float(classes[0]["lo"]), float(classes[1]["lo"])),
        forest.getSeed(), forest.getBootstrap(),
    )
    rows = staged(binned(values, label, rules.cuts, bins), "binned")
    nodes = whole_trees(rows, rules, small) if sum(rules.classes) <= HELD else grown(rows, rules, small)
    # a fit on one row of each class stores the parameters; its nodes are replaced
    one, other = (frame.filter(F.col(label) == k).limit(1) for k in (0, 1))
    path = scratch_path(frame.sparkSession, "forest")
    forest.fit(one.unionByName(other)).write().save(path)
    _saved(nodes, rules).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
