"""Packing token sequences by best-fit decreasing.

Each text is tokenised where it lies.  Documents longer than a sequence are first cut into full windows; what remains goes,
longest first, into the open window with the least sufficient room, which a segment tree over remaining capacities finds
in a logarithmic number of steps.  Windows are filled in groups of about ``GROUP`` pieces, dealt out by a hash of a piece
number, so no task ever holds more than a group, however large the corpus; the gap that a group leaves is a few windows.

Edge rules: a null or empty text is one piece that holds only the end id; long texts are cut, never shortened; repeated
rows are packed each; ties in length go by key and start; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from riskweave.llm.batches import by_bytes, worker_store
from riskweave.sources.scratch import staged

WINDOW = 4096
END_ID = 2
GROUP = 8192  # pieces that are packed together
MARKS = ".,;:!?*#$%&|"  # runs of these after a letter or digit are tokens of their own


class WordIds(dict):
    """Ids of each blank-separated word as little-endian bytes; the tokenizer never joins across blanks.

    Words that differ in case or end marks share one call, since the tokenizer lowers case and cuts before marks.  At most
    ``limit`` words are remembered: when half of them are new, those of the older half that were not met again are forgotten.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__()
        self.tokenizer, self.limit, self.old = Tokenizer.from_file(path), limit, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.pop(word, None)
        if value is None:
            value = self.learned(word)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def learned(self, word: str) -> bytes:
        plain = word.isalpha() and word.islower()
        core = word if plain else word.rstrip(MARKS)
        if plain:
            return self.encoded(word)
        if word.isascii() and word != word.lower() and "<|" not in word:
            return self[word.lower()]
        if core and core != word and unicodedata.normalize("NFC", core[-1]).lower()[-1].isalnum():
            return self[core] + self[word[len(core) :]]
        return self.encoded(word)

    def encoded(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids cut into windows: key, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_store(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        for batch in by_bytes(batches, 1):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, coded in enumerate(words.of(t or "") for t in batch.column(1).to_pylist()):
                coded += end
                n = len(coded) // 4
                for s in range(0, n, WINDOW):
                    part = coded[4 * s : 4 * (s + WINDOW)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    for name in names[1:5]:
        schema = schema.add(name, T.LongType())
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(docs[key].alias(key), docs[text].alias("whole_text")).mapInArrow(run, schema)


class Capacities:
    """Open windows by remaining capacity: a segment tree of counts over 0..window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        self.step(capacity, 1)

    def step(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity that is ``length`` or more: (capacity, window)."""
        node, count = length + self.leaves, self.count
        while not count[node]:
            while node & 1:  # a right child: everything to the right lies above
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        capacity = node - self.leaves
        self.step(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """For lengths in decreasing order: the window each goes to and its offset there."""
    tree, placed, opened = Capacities(window), [], 0
    for length in lengths:
        found = tree.tightest(length)
        if found is None:
            capacity, at, opened = window, opened, opened + 1
        else:
            capacity, at = found
        placed.append((at, window - capacity))
        if capacity > length:
            tree.add(capacity - length, at)
    return placed


def pack(cut: DataFrame, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``cut`` (from ``pieces``) with ``sequence_id`` and ``offset``; sequences of one group are numbered from group * 2**32."""
    numbered = staged(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group))
    schema = T.StructType(
        [*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def fill(table: pa.Table) -> pa.Table:  # Arrow keeps whole numbers beside nulls as they are
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist())
        first = table.column("pack_group")[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([first + w for w, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64())).select(schema.fieldNames())

    dealt = numbered.withColumn("pack_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(fill, schema)
