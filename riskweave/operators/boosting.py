"""Boosted trees from counts that the partitions add up: Spark's algorithm with rows binned once and held in blocks.

Spark's learner visits every feature of every row at each level with several statistics.  Here features of few values share one code
byte, whose counts hold those of each of them; of two siblings only the smaller is counted, the other is what is left of their
parent; and a block of rows is counted by a few array operations.  Trees, gains, residuals of the logistic loss, shares of rows and
features follow Spark's learner.  Which rows a tree sees is hashed from row and tree, so it does not depend on partitions.

The rows of a fit of moderate size meet in one task, which keeps them while all trees grow: a job a level takes longer to start than such
rows to count.  Of more rows, blocks hold codes, labels and the score so far; the next tree starts from the blocks that the last one has updated.  Every
``TREES_APART`` trees the blocks are made anew from the stored rows, so a lost one costs few steps.  What reaches the driver are sums by
node, code and label, whose number depends on the parameters and the partitions (one a core at most).  The result is
Spark's own model: its node table is written in the saved form and loaded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.deep_forest import cuts_of, features_drawn, node_features
from riskweave.sources.scratch import ROWS_PER_PARTITION, scratch_path, spread, staged

ROWS_A_TASK = 65_536  # fewer are not worth a task
TREES_APART = 20
HELD = 2_097_152  # rows that one task keeps while it grows all trees of a fit, at some 40 bytes a row
HELD_OF_MANY = 8_388_608  # the same, if other fits fill the cores
ROWS_AT_ONCE = 131_072  # rows that a task handles in one step
TINY = 1e-15  # a gain below is rounding

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # rows, codes [code, row], labels, scores, squares by leaf


@dataclass
class Codes:
    """Where each feature's bins are: ``bin = code[column] // stride % size``."""

    cuts: list[np.ndarray]
    width: int  # values of a code
    column: list[int] = field(default_factory=list)
    stride: list[int] = field(default_factory=list)
    columns: int = 0
    parts: dict[int, tuple[list[int], np.ndarray]] | None = None

    def __post_init__(self):
        used = self.width + 1
        for size in self.sizes:
            if used * size > self.width:  # a new code
                self.columns, used = self.columns + 1, 1
            self.column.append(self.columns - 1)
            self.stride.append(used)
            used *= size

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def of(self, values: np.ndarray) -> np.ndarray:
        """The codes of rows of values; a missing value is in the last bin."""
        out = np.zeros((self.columns, len(values)), np.uint8 if self.width <= 256 else np.uint16)
        for i, cut in enumerate(self.cuts):
            out[self.column[i]] += (np.searchsorted(cut, values[:, i], side="left") * self.stride[i]).astype(out.dtype)
        return out

    def bins(self, feature: int) -> np.ndarray:
        """The feature's bin for every value of its code."""
        return np.arange(self.width) // self.stride[feature] % self.sizes[feature]

    def by_features(self, *sums: np.ndarray) -> np.ndarray:
        """Sums [code, value], one after the other, as [which, feature, bin]; bins that a feature does not have are 0."""
        sizes = self.sizes
        out = np.zeros((len(sums), len(sizes), max(sizes)))
        if self.parts is None:  # which features have a code for themselves, and what adds up the values of a shared code by bin
            shared: dict[int, list[int]] = {}
            for f, column in enumerate(self.column):
                shared.setdefault(column, []).append(f)
            self.parts = {c: (fs, np.concatenate([self.bins(f) == np.arange(sizes[f])[:, None] for f in fs]).astype(float)) for c, fs in shared.items()}
        for column, (features, adds) in self.parts.items():
            part = np.stack([s[column] for s in sums])
            if len(features) == 1:
                out[:, features[0], : sizes[features[0]]] = part[:, : sizes[features[0]]]
                continue
            part, at = part @ adds.T, 0
            for f in features:
                out[:, f, : sizes[f]] = part[:, at : at + sizes[f]]
                at += sizes[f]
        return out

    def by_feature(self, sums: np.ndarray, feature: int) -> np.ndarray:
        """Sums [code, ..., value] as [..., bin] of one feature."""
        size, stride = self.sizes[feature], self.stride[feature]
        part = sums[self.column[feature]]
        used = part.shape[-1] // (size * stride) * size * stride
        return part[..., :used].reshape(*part.shape[:-1], -1, size, stride).sum(axis=(-3, -1))


@dataclass
class Tree:
    """Nodes as found, children after their parent; ``goes_left`` is by value of the code."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    sums: list[np.ndarray] = field(default_factory=lambda: [np.zeros(4)])  # rows of label 0 and 1, sum and squares of the residuals, weighted
    column: list[int] = field(default_factory=lambda: [-1])
    goes_left: list[np.ndarray | None] = field(default_factory=lambda: [None])
    value: list[float] = field(default_factory=lambda: [0.0])

    def child(self, sums: np.ndarray) -> int:
        for held, x in zip(
            (self.feature, self.cut, self.left, self.right, self.gain, self.sums, self.column, self.goes_left, self.value),
            (-1, 0, -1, -1, -1.0, sums, -1, None, 0.0), strict=True,
        ):
            held.append(x)
        return len(self.feature) - 1

    def rows_of(self, codes: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
        """The given rows by the node that they have reached so far."""
        at, out = [(0, rows)], {}
        while at:
            node, rows = at.pop()
            if self.left[node] < 0:
                out[node] = rows
                continue
            small = self.goes_left[node][codes[self.column[node]][rows]]
            at += [(self.left[node], rows[small]), (self.right[node], rows[~small])]
        return out


@dataclass
class Rules:
    """What growing depends on besides the rows."""

    codes: Codes
    width: int
    drawn: int
    depth: int
    least: int
    least_gain: float
    weights: tuple[float, float]
    step: float
    share: float
    seed: int

    @property
    def shape(self) -> tuple[int, int, int, int]:
        """Of a node's sums: (rows, residuals), code, label, value."""
        return (2, self.codes.columns, 2, self.codes.width)


def seen_by(tree: int, rows: np.ndarray, rules: Rules) -> np.ndarray:
    """Places of the rows that a tree sees, a share drawn by a hash of row and tree."""
    if rules.share >= 1.0:
        return np.arange(len(rows))
    start = np.random.SeedSequence([rules.seed & 0xFFFFFFFF, tree]).generate_state(1, np.uint64)[0]
    z = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + start
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.flatnonzero(((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < rules.share)


def residuals(tree: int, label: np.ndarray, score: np.ndarray) -> np.ndarray:
    """What a tree is fitted to: labels -1 and 1 first, then the slope of the logistic loss."""
    y = 2.0 * label - 1.0
    return y if tree == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * score, 700.0)))


def counted(block: Block, t: int, tree: Tree, nodes: list[int], rules: Rules) -> np.ndarray:
    """For each node: rows and weighted residuals by code, label and value [node, (rows, residuals), code, label, value]."""
    rows, codes, label, score, _ = block
    found = tree.rows_of(codes, seen_by(t, rows, rules))
    kept = [found[n] for n in nodes]
    at = np.concatenate(kept)
    y, width = label[at], rules.codes.width
    base = (np.repeat(np.arange(len(nodes)), [len(k) for k in kept]) * 2 + y) * width
    r = residuals(t, y, score[at]) * np.array(rules.weights)[y]
    out = np.empty((2, len(codes), len(nodes) * 2 * width))
    for c, code in enumerate(codes):
        key = base + code[at]
        out[0, c], out[1, c] = np.bincount(key, minlength=out.shape[2]), np.bincount(key, r, out.shape[2])
    return np.moveaxis(out.reshape(2, len(codes), len(nodes), 2, width), 2, 0)


def leaf_squares(block: Block, t: int, tree: Tree, rules: Rules) -> np.ndarray:
    """Weighted squares of the residuals of a tree's rows by leaf; the scores must be those before the tree."""
    rows, codes, label, score, _ = block
    out = np.zeros(len(tree.left))
    for node, at in tree.rows_of(codes, seen_by(t, rows, rules)).items():
        out[node] = (residuals(t, label[at], score[at]) ** 2 * np.array(rules.weights)[label[at]]).sum()
    return out


def added(block: Block, tree: Tree) -> np.ndarray:
    _, codes, _, score, _ = block
    out = score.copy()
    for node, at in tree.rows_of(codes, np.arange(len(score))).items():
        out[at] += tree.value[node]
    return out


# ---- the best split of a node ----


def best_split(sums: np.ndarray, t: int, node: int, rules: Rules) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, sums left, sums right) of a node's sums [(rows, residuals), code, label, value]; None without a gain."""
    w0, w1 = rules.weights
    drawn = node_features(t, node, rules)
    cells = rules.codes.by_features(sums[0, :, 0], sums[0, :, 1], sums[1].sum(axis=1))[:, drawn]  # [(rows, rows, residuals), feature, bin]
    if cells.shape[2] < 2:
        return None
    left = cells.cumsum(axis=2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    weight, left_weight, right_weight = (x[0] * w0 + x[1] * w1 for x in (total, left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = (left[2] ** 2 / left_weight + right[2] ** 2 / right_weight - total[2] ** 2 / weight) / weight
    allowed = (left[0] + left[1] >= max(rules.least, 1)) & (right[0] + right[1] >= max(rules.least, 1))
    fall = np.where(allowed, fall, -1.0)
    f, cut = np.unravel_index(int(fall.argmax()), fall.shape)
    if fall[f, cut] <= TINY or fall[f, cut] < rules.least_gain:
        return None
    return float(fall[f, cut]), int(drawn[f]), int(cut), left[:, f, cut], right[:, f, cut]


def value_of(sums: np.ndarray, rules: Rules) -> float:
    weight = sums[0] * rules.weights[0] + sums[1] * rules.weights[1]
    return float(sums[2] / weight) if weight else 0.0


def total_of(blocks: RDD, made) -> np.ndarray:
    """Sum over all blocks, in the order of the partitions; many partitions are added up on the way."""
    zero = lambda part: [sum((made(b) for b in part), 0.0)]
    sums = blocks.mapPartitions(zero)
    parts = blocks.getNumPartitions()
    return sums.treeReduce(lambda a, b: a + b, 2) if parts > 96 else sum(sums.collect())


def grown(blocks: RDD, t: int, rules: Rules, before: Tree | None) -> Tree:
    """Tree ``t``; ``before`` gets the squares of its leaves, which the blocks carry."""
    tree = Tree()
    whole = total_of(blocks, lambda b: np.concatenate([b[4], counted(b, t, tree, [0], rules).reshape(-1)]))
    if before is not None:
        squares_up(before, whole[: len(before.left)])
    root = whole[len(whole) - int(np.prod(rules.shape)) :].reshape(rules.shape)
    grow(tree, t, root, rules, lambda nodes: total_of(blocks, lambda b: counted(b, t, tree, nodes, rules)))
    return tree


def grow(tree: Tree, t: int, root: np.ndarray, rules: Rules, count: Callable[[list[int]], np.ndarray], told: Callable[[int], None] | None = None) -> None:
    """All nodes of tree ``t`` from the sums of its root; ``count`` gives those of other nodes, ``told`` hears of each that is split."""
    held = {0: root}
    top = root[:, 0].sum(axis=-1)
    tree.sums[0] = np.array([*top[0], top[1].sum(), 0.0])
    for level in range(rules.depth):
        ask: dict[int, tuple[int, int]] = {}  # the smaller child, its sibling and their parent
        for node, sums in held.items():
            found = best_split(sums, t, node, rules)
            if found is None:
                continue
            gain, feature, cut, left, right = found
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
            tree.column[node], tree.goes_left[node] = rules.codes.column[feature], rules.codes.bins(feature) <= cut
            a, b = (tree.child(np.append(x, 0.0)) for x in (left, right))
            tree.left[node], tree.right[node] = a, b
            if told is not None:
                told(node)
            small, large = (a, b) if left[:2].sum() <= right[:2].sum() else (b, a)
            ask[small] = (large, node)
        if not ask or level + 1 == rules.depth:
            break
        nodes = list(ask)
        found = count(nodes)
        later = {}
        for small, sums in zip(nodes, found, strict=True):
            large, parent = ask[small]
            later[small], later[large] = sums, held[parent] - sums
        held = dict(sorted(later.items()))
    tree.value = [value_of(s, rules) * (1.0 if t == 0 else rules.step) for s in tree.sums]


def squares_up(tree: Tree, by_leaf: np.ndarray) -> None:
    for node in range(len(tree.left) - 1, -1, -1):  # children come after their parent
        a, b = tree.left[node], tree.right[node]
        tree.sums[node][3] = by_leaf[node] if a < 0 else tree.sums[a][3] + tree.sums[b][3]


def boosted(stored: RDD, trees: int, rules: Rules) -> list[Tree]:
    """All trees of the ensemble from blocks of (rows, codes, labels)."""
    made: list[Tree] = []
    blocks, last = _scored(stored, [], rules), None
    for t in range(trees):
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        tree = grown(blocks, t, rules, made[-1] if made else None)
        if last is not None:
            last.unpersist()
        made.append(tree)
        last = blocks
        blocks = _scored(stored, list(made), rules) if len(made) % TREES_APART == 0 else _updated(last, t, tree, rules)
    squares_up(made[-1], total_of(blocks, lambda b: b[4]))
    last.unpersist()
    return made


def _updated(blocks: RDD, t: int, tree: Tree, rules: Rules) -> RDD:
    return blocks.map(lambda b: (*b[:3], added(b, tree), leaf_squares(b, t, tree, rules)))


def _scored(stored: RDD, trees: list[Tree], rules: Rules) -> RDD:
    def start(stored_block: tuple) -> Block:
        block = (*stored_block, np.zeros(len(stored_block[0])), np.empty(0))
        for t, tree in enumerate(trees):
            squares = leaf_squares(block, t, tree, rules) if t + 1 == len(trees) else np.empty(0)
            block = (*stored_block, added(block, tree), squares)
        return block

    return stored.map(start)


# ---- a task that keeps the rows while all trees grow ----


class Chunk:
    """Some rows of a task: codes, labels, scores, and for the tree that grows the rows of each open node or leaf."""

    def __init__(self, blocks: list[tuple], rules: Rules):
        self.rows, self.label = (np.concatenate([b[i] for b in blocks]) for i in (0, 2))
        self.codes = np.concatenate([b[1] for b in blocks], axis=1)
        self.weights, self.width = np.array(rules.weights), rules.codes.width
        self.score = np.zeros(len(self.rows))
        offset = self.offset(self.label)
        self.counts = np.stack([np.bincount(code + offset, minlength=2 * self.width) for code in self.codes])

    def offset(self, label: np.ndarray) -> np.ndarray:
        return label.astype(np.intp) * self.width

    def begin(self, t: int, rules: Rules) -> None:
        seen = seen_by(t, self.rows, rules).astype(np.int32)
        left_out = np.ones(len(self.rows), bool)
        left_out[seen] = False
        self.at, self.unseen = {0: seen}, np.flatnonzero(left_out).astype(np.int32)
        self.weighted = residuals(t, self.label, self.score) * self.weights[self.label]

    def add_to(self, sums: np.ndarray, node: int) -> None:
        """The chunk's part of a node's sums; at the root, rows are counted as all rows without those that are not seen."""
        at = self.at[node].astype(np.intp)
        if not len(at):
            return
        offset, r = self.offset(self.label.take(at)), self.weighted.take(at)
        if node == 0:
            rest = self.unseen.astype(np.intp)
            rest_offset = self.offset(self.label.take(rest))
        for k, code in enumerate(self.codes):
            key = code.take(at) + offset
            n = self.counts[k] - np.bincount(code.take(rest) + rest_offset, minlength=2 * self.width) if node == 0 else np.bincount(key, minlength=2 * self.width)
            sums[0, k] += n.reshape(2, -1)
            sums[1, k] += np.bincount(key, r, 2 * self.width).reshape(2, -1)

    def split(self, tree: Tree, node: int) -> None:
        at = self.at.pop(node)
        small = tree.goes_left[node].take(self.codes[tree.column[node]].take(at))
        self.at[tree.left[node]], self.at[tree.right[node]] = at[small], at[~small]

    def finish(self, tree: Tree) -> np.ndarray:
        """Adds the tree to the scores; weighted squares of the residuals by leaf."""
        squares = np.zeros(len(tree.left))
        for node, at in self.at.items():
            r = self.weighted.take(at)
            squares[node] = (r * r / self.weights[self.label.take(at)]).sum()
            self.score[at] += tree.value[node]
        for node, at in tree.rows_of(self.codes, self.unseen).items():
            self.score[at] += tree.value[node]
        return squares


def chunks_of(blocks: Iterator[tuple], rules: Rules) -> list[Chunk]:
    held, n, out = [], 0, []
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= ROWS_AT_ONCE:
            out.append(Chunk(held, rules))
            held, n = [], 0
    return [*out, Chunk(held, rules)] if held else out


def boosted_here(chunks: list[Chunk], trees: int, rules: Rules, told_of: Callable[[Tree], None] | None = None) -> list[Tree]:
    """All trees of the ensemble from the rows of one task; ``told_of`` hears of each when the scores hold it."""
    made: list[Tree] = []

    def count(nodes: list[int]) -> np.ndarray:
        sums = np.zeros((len(nodes), *rules.shape))
        for chunk in chunks:
            for own, node in zip(sums, nodes, strict=True):
                chunk.add_to(own, node)
        return sums

    for t in range(trees):
        tree = Tree()
        for chunk in chunks:
            chunk.begin(t, rules)

        def told(node: int, tree=tree) -> None:
            for chunk in chunks:
                chunk.split(tree, node)

        grow(tree, t, count([0])[0], rules, count, told)
        squares_up(tree, sum(chunk.finish(tree) for chunk in chunks))
        made.append(tree)
        if told_of is not None:
            told_of(tree)
    return made


def boosted_in_a_task(stored: RDD, trees: int, rules: Rules) -> list[Tree]:
    """``boosted`` where all rows of the fit meet in one task and stay there until the last tree."""
    return stored.coalesce(1).mapPartitions(lambda part: [boosted_here(chunks_of(part, rules), trees, rules)]).collect()[0]


def average_precision(score: np.ndarray, label: np.ndarray) -> float | None:
    """Mean over the positives of the precision at their score; rows of one score count together."""
    hit = label == 1
    values, n = np.unique(score[hit], return_counts=True)
    if not len(values):
        return None
    tp = np.cumsum(n[::-1])[::-1]
    below = np.searchsorted(np.sort(score[~hit]), values, side="left")
    return float((n * (tp / (tp + (len(score) - tp[0]) - below))).sum() / tp[0])


def _followed(blocks: Iterator[tuple], trees: int, rules: Rules) -> Iterator[list[tuple[float | None, float | None]]]:
    """Average precision of the rows of the fit and of the others after each tree, from blocks of (in the fit, rows, codes, labels)."""
    inside, outside = [], []
    for fits, *block in blocks:
        (inside if fits else outside).append(tuple(block))
    others = [[codes, label, np.zeros(len(label))] for _, codes, label in outside]
    label, other_label = (np.concatenate([np.empty(0, np.uint8), *(b[2] for b in part)]) for part in (inside, outside))
    chunks, found = chunks_of(iter(inside), rules), []
    del inside, outside

    def told_of(tree: Tree) -> None:
        for codes, _, score in others:
            for node, at in tree.rows_of(codes, np.arange(len(score))).items():
                score[at] += tree.value[node]
        other_score = np.concatenate([np.empty(0), *(score for _, _, score in others)])
        found.append((average_precision(np.concatenate([c.score for c in chunks]), label), average_precision(other_score, other_label)))

    boosted_here(chunks, trees, rules, told_of)
    yield found


def followed(frame: DataFrame, others: DataFrame, learner: GBTClassifier) -> list[tuple[float | None, float | None]]:
    """Average precision of the rows that ``learner`` is fitted on, and of other rows, after each tree; all of them meet in one task."""
    label = learner.getLabelCol()
    values, rules, rows, _ = _ready(frame, learner)
    parts = [blocks_of(v, label, rules.codes, rows).map(lambda b, k=k: (k == 0, *b)) for k, v in enumerate((values, _values(others, learner)))]
    trees = learner.getMaxIter()
    return frame.sparkSession.sparkContext.union(parts).coalesce(1).mapPartitions(lambda part: _followed(part, trees, rules)).collect()[0]


# ---- rows in, model out ----


def blocks_of(values: DataFrame, label: str, codes: Codes, rows: int) -> RDD:
    """(rows, codes, labels) of up to ``ROWS_PER_PARTITION`` rows, spread evenly and stored."""
    kind = np.uint8 if codes.width <= 256 else np.uint16

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        parts = table.column("row").to_numpy(), codes.of(x), table.column("label").to_numpy().astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["rows", "codes", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, ROWS_PER_PARTITION - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == ROWS_PER_PARTITION:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    spark = values.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    numbered = values.select("row", "values", F.col(label).cast("int").alias("label"))
    made = numbered.mapInArrow(run, "rows binary, codes binary, labels binary").repartition(parts)

    def read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["rows"], np.int64)
        return ids, np.frombuffer(row["codes"], kind).reshape(-1, len(ids)), np.frombuffer(row["labels"], np.uint8)

    return staged(made, "blocks").rdd.map(read).coalesce(parts)


def node_rows(trees: list[Tree], rules: Rules) -> Iterator[tuple]:
    """The node table as Spark's learner stores it."""
    w0, w1 = rules.weights
    for t, tree in enumerate(trees):
        for i, (n0, n1, s, q) in enumerate(tree.sums):
            weight, leaf = n0 * w0 + n1 * w1, tree.left[i] < 0
            mean = s / weight if weight else 0.0
            limit = [] if leaf else [float(rules.codes.cuts[tree.feature[i]][tree.cut[i]])]
            impurity = max(0.0, float(q / weight - mean * mean)) if weight else 0.0
            stats = [float(weight), float(s), float(q)]
            split = (tree.feature[i], limit, -1)
            yield t, (i, float(mean), impurity, stats, int(n0 + n1), float(tree.gain[i]), tree.left[i], tree.right[i], split)


SAVED = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def _values(frame: DataFrame, learner: GBTClassifier) -> DataFrame:
    """Rows, numbered, with their features as arrays, stored."""
    return staged(spread(frame).select(F.monotonically_increasing_id().alias("row"), vector_to_array(learner.getFeaturesCol()).alias("values"), learner.getLabelCol()), "values")


def _ready(frame: DataFrame, learner: GBTClassifier) -> tuple[DataFrame, Rules, int, set[int]]:
    """The stored rows of a fit, what growing depends on, how many rows they are, and their labels."""
    label, weight = learner.getLabelCol(), learner.getWeightCol()
    ends = F.min(weight).alias("lo"), F.max(weight).alias("hi"), F.count(F.lit(1)).alias("n")
    classes = {r["y"]: r for r in frame.groupBy(F.col(label).cast("int").alias("y")).agg(*ends).collect()}
    if not classes or not set(classes) <= {0, 1}:
        raise ValueError(f"need labels 0 and 1, have {sorted(classes, key=str)}")
    if any(r["lo"] != r["hi"] for r in classes.values()):
        raise ValueError("weights must be equal within a class")
    values = _values(frame, learner)
    width = values.select(F.size("values")).first()[0]
    codes = Codes(cuts_of(values, width, learner.getMaxBins()), max(256, learner.getMaxBins()))
    rules = Rules(
        codes, width, features_drawn(learner.getFeatureSubsetStrategy() if learner.getFeatureSubsetStrategy() != "auto" else "all", width),
        learner.getMaxDepth(), learner.getMinInstancesPerNode(), learner.getMinInfoGain(),
        tuple(float(classes[k]["lo"]) if k in classes else 0.0 for k in (0, 1)), learner.getStepSize(), learner.getSubsamplingRate(), learner.getSeed(),
    )
    return values, rules, sum(r["n"] for r in classes.values()), set(classes)


def fit(frame: DataFrame, learner: GBTClassifier, one_of_many: bool = False) -> GBTClassificationModel:
    """``learner`` fitted on ``frame``; its weights must depend on the label only, as class weights do.

    ``one_of_many``: other fits run at the same time, so that a task for each of them fills the cores.
    """
    label = learner.getLabelCol()
    values, rules, rows, classes = _ready(frame, learner)
    stored = blocks_of(values, label, rules.codes, rows)
    grow_all = boosted_in_a_task if rows <= (HELD_OF_MANY if one_of_many else HELD) else boosted
    trees = grow_all(stored, learner.getMaxIter(), rules)
    few = [frame.filter(F.col(label) == k).limit(1) for k in sorted(classes)]
    sample = staged((few[0].unionByName(few[1]) if len(few) == 2 else few[0]).coalesce(1), "two-rows")
    return _loaded(learner, sample, trees, rules)


def _loaded(learner: GBTClassifier, sample: DataFrame, trees: list[Tree], rules: Rules) -> GBTClassificationModel:
    """The trees as Spark's model: one tree fitted on a row of each class is stored, then its nodes, weights and numbers are replaced."""
    spark, first, path = sample.sparkSession, scratch_path(sample.sparkSession, "first-tree"), scratch_path(sample.sparkSession, "boosted")
    learner.copy({learner.maxIter: 1}).fit(sample).write().save(first)
    told = json.loads(spark.read.text(f"{first}/metadata").first()[0])
    told["numTrees"] = told["paramMap"]["maxIter"] = len(trees)
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = spark.read.parquet(f"{first}/treesMetadata")  # number, metadata, weight; their names differ between versions
    _, told, _ = one.first()
    each = [(t, told, 1.0 if t == 0 else rules.step) for t in range(len(trees))]
    spark.createDataFrame(each, one.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(list(node_rows(trees, rules)), SAVED).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
