"""Exact stratified splits and folds without shuffling the rows.

Every row gets a hash of seed and key.  A split or fold is a block of ranks of that
hash within the class, so it is enough to know the hash value at each block's end.
These cut-offs are found by counting hash prefixes (a few thousand counts per pass)
and narrowing to one prefix at a time; after that, assignment is a plain expression on
each row.  Sizes are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import fixed_values as fv

PREFIX_STEP = 3  # hex digits per narrowing pass: 4096 counts per open cut-off
FETCH_LIMIT = 10_000  # hashes of one prefix that may be fetched to pick the cut-off


def key_hash(seed: int, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def _class_expr(label: str | None) -> Column:
    return F.col(label).cast("string") if label else F.lit("all")


def _hashed(frame: DataFrame, label: str | None, seed: int, keys: Sequence[str]) -> DataFrame:
    return frame.select(_class_expr(label).alias("c"), key_hash(seed, keys).alias("h"))


def _prefix_counts(hashed: DataFrame, depth: int) -> list:
    """Rows per class and hash prefix; at most 4096 rows per class (or per open prefix)."""
    prefix = F.substring("h", 1, depth).alias("p")
    return hashed.groupBy("c", prefix).agg(F.count(F.lit(1)).alias("n")).collect()


def class_sizes(counts: list) -> dict[str, int]:
    """Rows of each class; a NULL label belongs to no class and is refused."""
    sizes: dict[str, int] = {}
    for row in counts:
        if row["c"] is None:
            raise ValueError("the label is NULL in some rows: drop or fill them before splitting")
        sizes[row["c"]] = sizes.get(row["c"], 0) + row["n"]
    return sizes


def _cutoffs(hashed: DataFrame, ranks: dict[str, list[int]], counts: list) -> dict[tuple[str, int], str]:
    """Hash value at each wanted rank (1-based) of each class; ``counts`` are the first prefix counts."""
    # open item: (class, rank, prefix, rows of the class before the prefix)
    open_items = [(c, r, "", 0) for c, wanted in ranks.items() for r in wanted]
    out: dict[tuple[str, int], str] = {}
    depth = 0
    while open_items:
        depth += PREFIX_STEP
        if depth > PREFIX_STEP:
            counts = _prefix_counts(hashed.filter(_under(sorted({(c, p) for c, _, p, _ in open_items}))), depth)
        per_class: dict[str, list] = {}
        for row in sorted(counts, key=lambda r: r["p"]):
            per_class.setdefault(row["c"], []).append(row)
        still_open, fetch = [], []
        for c, rank, prefix, before in open_items:
            for row in per_class[c]:
                if not row["p"].startswith(prefix):
                    continue
                if before + row["n"] >= rank:
                    small = row["n"] <= FETCH_LIMIT or depth >= 32
                    (fetch if small else still_open).append((c, rank, row["p"], before))
                    break
                before += row["n"]
        if fetch:
            wanted = sorted({(c, p) for c, _, p, _ in fetch})
            hashes = (
                hashed.filter(_under(wanted)).groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).collect()
            )  # at most FETCH_LIMIT rows per prefix
            for c, rank, prefix, before in fetch:
                ordered = sorted((r["h"], r["n"]) for r in hashes if r["c"] == c and r["h"].startswith(prefix))
                for h, n in ordered:
                    before += n
                    if before >= rank:
                        out[(c, rank)] = h
                        break
        open_items = still_open
    return out


def _under(prefixes: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(False)
    for c, p in prefixes:
        condition = condition | ((F.col("c") == c) & F.col("h").startswith(p))
    return condition


def ranked_blocks(
    frame: DataFrame,
    keys: Sequence[str],
    label: str | None,
    seed: int,
    counts: list,
    block_ends: dict[str, list[int]],
    names: Sequence,
    output: str,
) -> DataFrame:
    """Name each row by its block of hash ranks within its class.

    ``block_ends[class]`` holds the last rank of every block but the final one.  ``keys``
    must identify a row; rows that share a key share a block.
    """
    wanted = {c: [e for e in ends if e > 0] for c, ends in block_ends.items()}
    cut = _cutoffs(_hashed(frame, label, seed, keys), wanted, counts)
    h, cls = F.col("_hash"), _class_expr(label)
    block = F.lit(None)
    for c, ends in block_ends.items():
        chain = F.lit(names[len(ends)])
        for i in reversed(range(len(ends))):
            if ends[i] > 0:
                chain = F.when(h <= F.lit(cut[(c, ends[i])]), F.lit(names[i])).otherwise(chain)
        block = F.when(cls.eqNullSafe(F.lit(c)), chain).otherwise(block)
    # the hash is its own column so that it is computed once per row, not once per comparison
    return frame.withColumn("_hash", key_hash(seed, keys)).withColumn(output, block).drop("_hash")


def apportioned(sizes: dict[str, int], wanted: int) -> dict[str, int]:
    """Share ``wanted`` rows over the classes by largest remainder, ties to the lower class."""
    total = sum(sizes.values())
    exact = {c: n * wanted / total for c, n in sizes.items()}
    out = {c: math.floor(v) for c, v in exact.items()}
    order = sorted(sizes, key=lambda c: (-(exact[c] - out[c]), c))
    for c in order[: wanted - sum(out.values())]:
        out[c] += 1
    return out


def train_val_test(
    frame: DataFrame,
    label: str | None = "is_fraud",
    train: float = 0.6,
    validation: float = 0.2,
    test: float = 0.2,
    seed: int = fv.DEFAULT_SEED,
    keys: Sequence[str] = ("transaction_id",),
    output: str = "split",
) -> DataFrame:
    """Add a ``split`` column with exact, stratified train / validation / test sizes.

    The test share is taken first and the validation share from the rest; both round up.
    """
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1.0, got {train + validation + test}")
    counts = _prefix_counts(_hashed(frame, label, seed, keys), PREFIX_STEP)
    sizes = class_sizes(counts)
    n = sum(sizes.values())
    n_test = math.ceil(round(test * n, 6))
    in_test = apportioned(sizes, n_test)
    rest = {c: sizes[c] - in_test[c] for c in sizes}
    n_val = math.ceil(round(validation / (1 - test) * (n - n_test), 6)) if n > n_test else 0
    in_val = apportioned(rest, n_val)
    ends = {c: [in_test[c], in_test[c] + in_val[c]] for c in sizes}
    return ranked_blocks(frame, keys, label, seed, counts, ends, ["test", "validation", "train"], output)


def stratified_folds(
    frame: DataFrame,
    label: str | None = "is_fraud",
    folds: int = fv.CV_FOLDS,
    seed: int = fv.DEFAULT_SEED,
    keys: Sequence[str] = ("transaction_id",),
    output: str = "fold",
) -> DataFrame:
    """Add a ``fold`` column, 0 to folds-1; fold sizes differ by at most one, overall and per class.

    Position i of the rows laid out class after class belongs to fold i mod k; a class's
    count per fold follows from that, and hash ranks fill the folds in blocks.
    """
    counts = _prefix_counts(_hashed(frame, label, seed, keys), PREFIX_STEP)
    sizes = class_sizes(counts)
    ends, start = {}, 0
    for c in sorted(sizes):
        quota = [len(range((f - start) % folds, sizes[c], folds)) for f in range(folds)]
        ends[c] = [sum(quota[: i + 1]) for i in range(folds - 1)]
        start += sizes[c]
    return ranked_blocks(frame, keys, label, seed, counts, ends, list(range(folds)), output)


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def class_weights(frame: DataFrame, label: str = "is_fraud", scheme: str = "positive") -> DataFrame:
    """Add ``weight``: negatives/positives on positives ("positive") or n/(2 n_class) ("balanced")."""
    counts = class_balance(frame, label).first()
    negatives, positives = counts["negatives"], counts["positives"]
    if not positives or not negatives:
        raise ValueError("both classes must be present")
    if scheme == "positive":
        on_positive, on_negative = negatives / positives, 1.0
    elif scheme == "balanced":
        n = negatives + positives
        on_positive, on_negative = n / (2.0 * positives), n / (2.0 * negatives)
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    return frame.withColumn("weight", F.when(F.col(label) == 1, F.lit(on_positive)).otherwise(F.lit(on_negative)))


def class_balance(frame: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Negatives, positives and their ratio, as one row."""
    return frame.agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    ).withColumn(
        "positive_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    )


def split_summary(frame: DataFrame, label: str = "is_fraud", split: str = "split") -> DataFrame:
    """Rows, share and positive rate per split, and whether every row has a split."""
    parts = frame.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(label).alias("positives"), F.avg(label).alias("positive_rate")
    )
    whole = Window.partitionBy(F.lit(0))  # one row per split
    everything = F.sum("n_rows").over(whole)
    placed = F.sum(F.when(F.col(split).isNotNull(), F.col("n_rows"))).over(whole)
    return parts.select(
        split,
        "n_rows",
        (F.col("n_rows") / everything).alias("share"),
        "positives",
        "positive_rate",
        (placed == everything).cast("int").alias("is_complete"),
    )
