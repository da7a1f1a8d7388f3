"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words are counted over all texts.  Two words that differ by one inserted, deleted or replaced letter have letter counts at a
squared distance of at most two, and lengths at most one apart.  So words are laid out in blocks of one length, cut further by
how many letters of each of ``CLASSES`` letter classes they have: one edit moves at most one letter out of a class and one into
another, which names the few blocks that a block has to meet.  For two blocks one matrix product of their letter counts gives
all squared distances; what is at most two apart is verified letter by letter.

A block holds at most ``CHUNK`` words; a larger one is dealt out to several.  A task holds one block and streams the words it
meets; pairs never leave it, only each word's number of near words and the best of them.  Every word is compared with all
words of its blocks: nothing is capped.

A word's form is its near word of largest count (ties: smallest in code-point order), if that count is at least ``RATIO`` times its
own.  Following forms ends after few steps, as counts at least double; the ends are found by jumping.

Edge rules: null and empty texts have no words; a null key counts as empty text in the hash; texts and words of any length are
read whole; repeated rows count each; case is lowered for A to Z only; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.batches import by_bytes
from riskweave.sources.scratch import staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP = 97  # a run whose hash this divides loses a letter
MIN_LENGTH, MIN_COUNT = 5, 3
RATIO = 2
HELD = 200_000  # distinct words that a task counts before it hands them on
CLASSES = 5  # letter classes: code point modulo this
CHUNK = 2048  # words of a block
MEET = 8192  # words that meet a block at a time
LETTERS = 26 + 64  # a to z and the code points from C0 to FF
LONG = 1 << 22  # letters of words that are verified at a time


# ---- words ----


def words_of(key: str, text: str, slip: int | None = SLIP) -> Counter:
    """Lower-cased runs of one text with their counts; every ``slip``-th, by hash of key and run, loses one letter."""
    runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if not slip:
        return runs
    start, out = zlib.crc32(f"{key}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` letters and ``min_count`` occurrences in ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in by_bytes(batches, 1):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(k or "", t, slip).items() if t else ():
                    if len(word) >= min_length:
                        held[word] += n
            if len(held) >= HELD:
                yield handed_on()
        yield handed_on()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- blocks of letter counts ----


def code_points(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points in a row, and where each word begins (one more at the end)."""
    ends = np.cumsum([0, *map(len, found)])
    return np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64), ends


def letter_counts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x letters.  The words hold only a to z and code points from C0 to FF."""
    word = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    letter = np.where(points >= 0xC0, points - 0xC0 + 26, points - ord("a"))
    flat = np.bincount(word * LETTERS + letter, minlength=(len(ends) - 1) * LETTERS)
    return flat.reshape(-1, LETTERS)


class Block:
    """Words of a block with their code points and letter counts."""

    def __init__(self, found: list[str], counts: np.ndarray):
        self.words, self.n = np.array(found, dtype=object), np.asarray(counts, np.int64)
        self.points, self.ends = code_points(found)
        self.lengths = np.diff(self.ends)
        # sums of squares up to 2**24 are whole numbers in single precision
        kind = np.float32 if self.lengths.max(initial=0) < 2048 else np.float64
        self.letters = letter_counts(self.points, self.ends).astype(kind)
        self.squares = (self.letters * self.letters).sum(axis=1)

    def within_two(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Positions here and in ``other`` whose letter counts have a squared distance of at most two: one product."""
        used = np.flatnonzero(self.letters.any(axis=0))  # what no word here has adds nothing to the product
        kind = np.result_type(self.letters, other.letters)
        ones = np.ones(1, kind)
        mine = np.concatenate([self.letters[:, used], self.squares[:, None], np.broadcast_to(ones, (len(self.words), 1))], axis=1).astype(kind)
        half = np.full((len(other.words), 1), -0.5, kind)
        theirs = np.concatenate([other.letters[:, used], half, -0.5 * other.squares[:, None]], axis=1).astype(kind)
        hit = np.flatnonzero((mine @ theirs.T).ravel() >= -1)  # half the squared distance, negative
        return hit // len(other.words), hit % len(other.words)

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.points[self.ends[at][:, None] + np.arange(length)]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row pairs of code points differ by exactly one edit; ``b`` is as long as ``a`` or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def near_pairs(mine: Block, other: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that differ by exactly one edit."""
    i, j = mine.within_two(other)
    li, lj = mine.lengths[i], other.lengths[j]
    out = []
    apart = np.abs(li - lj) <= 1
    for a, b in np.unique(np.stack([li[apart], lj[apart]], axis=1), axis=0).tolist():
        at = np.flatnonzero((li == a) & (lj == b))
        step = max(1, LONG // max(a, b, 1))
        for s in range(0, len(at), step):
            p, q = i[at[s : s + step]], j[at[s : s + step]]
            x, y = mine.rows(p, a), other.rows(q, b)
            same = one_edit(x, y) if a <= b else one_edit(y, x)
            out.append((p[same], q[same]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def tallied(who: np.ndarray, whom: np.ndarray, of: Block, near: Block) -> tuple[list, list, list, list]:
    """For each word of ``of`` in pairs (who, whom): word, near words, and the best of them by count and code points."""
    if not len(who):
        return [], [], [], []
    distinct, place = np.unique(near.words[whom], return_inverse=True)
    order = np.lexsort((place, -near.n[whom], who))
    who, whom = who[order], whom[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(first, append=len(who))
    return of.words[who[first]].tolist(), size.tolist(), near.n[whom[first]].tolist(), near.words[whom[first]].tolist()


def class_counts(word: str):
    """Letters of each class, as a column."""
    letters = F.split(word, "")
    one = lambda c: F.size(F.filter(letters, lambda x: (F.ascii(x) % CLASSES) == c)).cast("int")
    return F.array(*[one(c) for c in range(CLASSES)])


def moves() -> list[list[int]]:
    """How the class counts of a near word can differ, one of each two directions."""
    unit = lambda *steps: [sum(s for c, s in steps if c == k) for k in range(CLASSES)]
    longer = [unit((c, 1)) for c in range(CLASSES)]
    return longer + [unit((c, 1), (d, -1)) for c in range(CLASSES) for d in range(c)]


def meetings(counted: DataFrame) -> DataFrame:
    """Words dealt to blocks: block, chunk, side (0: of the block, 1: the block itself as visitor, 2: visitor), word, n."""
    keyed = staged(counted.withColumn("at", class_counts("word")), "words")
    # a visitor knows in how many chunks its block is dealt out; one row a block
    sizes = keyed.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    shift = F.array(*[F.array(*map(F.lit, m)) for m in moves()])
    away = F.transform(shift, lambda m: F.zip_with("at", m, lambda a, b: a + b))
    visiting = keyed.select(F.explode(F.concat(F.array("at"), away)).alias("to"), "at", "word", "n")
    visiting = visiting.select(F.col("to").alias("block"), (F.when(F.col("to") == F.col("at"), 1).otherwise(2)).alias("side"), "word", "n")
    sizes = sizes.withColumnRenamed("at", "block")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    visitors = visiting.join(sizes, "block").select("block", every, "side", "word", "n")
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int").alias("chunk")
    holders = keyed.withColumnRenamed("at", "block").join(sizes, "block").select("block", own, F.lit(0).alias("side"), "word", "n")
    numbered = holders.unionByName(visitors).withColumn("block", F.concat_ws(",", F.col("block").cast("array<string>")))
    return numbered.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side")


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's near words and the best of them, as far as one block and its visitors tell."""
    holder: Block | None = None
    at, found, counts = None, [], []

    def tallies(visitors: Block, itself: bool) -> Iterator[tuple[list, list, list, list]]:
        i, j = near_pairs(holder, visitors)
        yield tallied(i, j, holder, visitors)
        if not itself:
            yield tallied(j, i, visitors, holder)

    for batch in batches:
        block, chunk, side = (batch.column(i) for i in range(3))
        keys = list(zip(block.to_pylist(), chunk.to_pylist(), side.to_pylist(), strict=True))
        names, n = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        begin = 0
        while begin < len(keys):
            end = begin
            while end < len(keys) and keys[end] == keys[begin] and end - begin < MEET:
                end += 1
            key, piece = keys[begin], slice(begin, end)
            if key[:2] != at:
                at, found, counts, holder = key[:2], [], [], None
            if key[2] == 0:  # the block's own words come first
                found, counts, holder = found + names[piece], counts + n[piece], None
            elif found:
                holder = holder or Block(found, counts)
                for columns in tallies(Block(names[piece], n[piece]), key[2] == 1):
                    if columns[0]:
                        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "best_n", "best"])
            begin = end


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``counted`` (word, n) that has a near word."""
    told = meetings(counted).select("block", "chunk", "side", "word", "n").mapInArrow(meet, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        told.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): where following forms ends.  Each round doubles the reach."""
    held = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        jumped = staged(jumped, "roots")
        held = jumped.select("word", "root")
        if jumped.filter("went").isEmpty():
            return held


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = SLIP,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    counted = staged(words(docs, key, text, slip, min_length, min_count), "counted")
    near = counted.join(near_words(counted), "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    placed = staged(
        near.select(
            "word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(placed.filter("form IS NOT NULL"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
