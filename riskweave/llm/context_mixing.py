"""Language-model scoring by logistic context mixing.

A text is coded as tokens (blank-separated words, A-Z lowered, then one end), and each token as binary decisions:

1. A token that training saw twice or more has a code, a Huffman code of its frequency and preferred class of texts and then
   its number there.  Every bit of every token is predicted by hashed contexts that reach the last two tokens, by the class that
   the document's tokens have voted for so far, and by the pointer to what followed the same contexts earlier in the document; they are
   combined in the logistic domain by gated weights and refined (``token_mixing``).  Counters, weights and refinement are
   learned from every bit of all training documents.
2. Training documents are dealt to ``CLASSES`` classes by a hash of their most frequent short token, which mostly tells the
   language; a token prefers the class in which it is ``LIFT`` times as frequent as in the corpus.
3. Any other token is coded as novel and then spelled, bit by bit in the same way: counters hashed by the last 0 to 3 bytes
   and the bits so far, weights gated by bit position and by the longest context seen in training, learned online from the
   words that training saw once, each word's own counts left out, and averaged over tasks; then refinement.

The sum of the token log-probabilities is the score; with the text's bytes it gives bits per byte.

Counts, hashed counters, weights and refinement cover all training documents.  What grows with the corpus (tokens, their
counts) is shuffled; only the hashed tables, whose sizes are constants, reach the driver and are broadcast.

Edge rules: a null or empty text is the end token alone; texts and tokens of any length are read whole; a null key has no
fold and trains; repeated rows count each; without any training document frequencies are zero and spelling alone scores;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskweave.llm import token_mixing
from riskweave.llm.tables import fold
from riskweave.sources.scratch import staged

ORDERS = 4  # predictors: the last 0..3 bytes
SLOT_BITS = 19
BLOCK_BITS = 13  # counters travel in blocks
GATES = 8 * (ORDERS + 1)
STEPS = 33  # of the refinement table
RATE = 0.5
WORDS_PER_TASK = 400_000
BUCKET_BYTES = 32_000_000  # text that is scored together
MOST_TOKENS = 1_000_000  # distinct tokens of a bucket
CLASSES = 8
LIFT = 1.5  # how much more frequent than in the corpus a token is in the class that prefers it
SHORT = 3  # bytes of a token that may tell the class
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, split at blanks and control spaces, then the end, which is the empty token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


# ---- spelling ------------------------------------------------------------------------------------------------------


class Spelled:
    """All bytes of many words laid end to end, each word closed by a blank."""

    def __init__(self, words: list[bytes]):
        body = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        self.ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.word = np.repeat(np.arange(len(words)), self.ends - starts + 1)
        self.byte = body.astype(np.uint64)
        place = np.arange(len(body)) - starts[self.word]
        context = np.zeros(len(body), np.uint64)
        self.contexts = [context]
        for k in range(1, ORDERS):  # bytes before the start of the word count as blanks
            back = np.where(place >= k, np.roll(self.byte, k), np.uint64(32))
            context = context * FACTOR + back + np.uint64(k)
            self.contexts.append(context)

    def bit(self, j: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The ``j``-th bit of every byte, from the top, and the counter slot of each predictor for it."""
        node = (np.uint64(1) << np.uint64(j)) | (self.byte >> np.uint64(8 - j))
        slots = []
        for k, c in enumerate(self.contexts):
            h = (c * FACTOR + node + np.uint64(k << 9)) * MIX
            slots.append(((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        return (self.byte >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64), slots


def empty_model() -> dict:
    return {
        "counts": np.zeros((ORDERS, 2 << SLOT_BITS), np.int32),  # zeros, then ones, of each slot
        "weights": np.full((GATES, ORDERS), 0.3),
        "stretched": np.zeros((ORDERS, 1 << SLOT_BITS), np.float32),
        "refined": None,
    }


def stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts in the logistic domain; exactly 0 where there are none."""
    return np.log((one + np.float32(0.2)) / (zero + np.float32(0.2)))


def predicted(model: dict, bit: np.ndarray, slots: list[np.ndarray], j: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inputs in the logistic domain and the gate of each event; ``own`` leaves out one count of the coded bit."""
    inputs, longest = np.empty((ORDERS, len(bit)), np.float32), np.zeros(len(bit), np.int64)
    for k, s in enumerate(slots):
        if own:
            counts = model["counts"][k]
            zero, one = counts[s] - (1 - bit), counts[s + (1 << SLOT_BITS)] - bit
            inputs[k] = stretched(zero.astype(np.float32), one.astype(np.float32))
        else:
            inputs[k] = model["stretched"][k][s]
        longest[inputs[k] != 0] = k + 1
    return inputs, j * (ORDERS + 1) + longest


def mixed(model: dict, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
    total = np.zeros(len(gate), np.float32)
    for k in range(ORDERS):
        total += inputs[k] * model["weights"][:, k].astype(np.float32)[gate]
    return np.clip(total, -12, 12)


def refine_cell(x: np.ndarray) -> np.ndarray:
    return np.rint((x + 12) * (STEPS - 1) / 24).astype(np.int64)


def learn(model: dict, words: list[bytes], hits: np.ndarray) -> None:
    """One online pass over ``words``: weights step with every bit, ``hits`` [gate, cell, bit] counts outcomes."""
    spelled = Spelled(words)
    for j in range(8):
        bit, slots = spelled.bit(j)
        inputs, gate = predicted(model, bit, slots, j, own=True)
        x = mixed(model, inputs, gate)
        error = bit - 1 / (1 + np.exp(-x))
        n = np.maximum(np.bincount(gate, minlength=GATES), 1)
        for k in range(ORDERS):
            model["weights"][:, k] += RATE / 10 * np.bincount(gate, error * inputs[k], GATES) / n
        hits += np.bincount((gate * STEPS + refine_cell(x)) * 2 + bit, minlength=hits.size).reshape(hits.shape)


def spelling(model: dict, words: list[bytes]) -> np.ndarray:
    """Log10 probability of each word's spelling."""
    spelled, total = Spelled(words), np.zeros(len(words))
    for j in range(8):
        bit, slots = spelled.bit(j)
        inputs, gate = predicted(model, bit, slots, j, own=False)
        x = mixed(model, inputs, gate)
        p = 1 / (1 + np.exp(-x))
        if model["refined"] is not None:
            p = (p + model["refined"][gate, refine_cell(x)]) / 2
        total += np.bincount(spelled.word, np.log10(np.where(bit == 1, p, 1 - p)), len(words))
    return total


def chunks(words: list[bytes], size: int = 20_000) -> Iterator[list[bytes]]:
    return (words[i : i + size] for i in range(0, len(words), size))


def counted(words: DataFrame) -> np.ndarray:
    """The hashed counters of all training words, each distinct word once."""
    width = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ORDERS, 2 << SLOT_BITS), np.int32)
        for batch in batches:
            for part in chunks(batch.column(0).to_pylist()):
                spelled = Spelled(part)
                for j in range(8):
                    bit, slots = spelled.bit(j)
                    for k, s in enumerate(slots):
                        np.add.at(table[k], s + (bit << SLOT_BITS), np.int32(1))
        yield from blocks_of(table)

    def blocks_of(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(table.reshape(-1, width)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tobytes()])], names=["block", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(body, np.int32)
        for i, block in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.astype(np.int32).tobytes()])], names=["block", "body"])

    parts = words.mapInArrow(count, "block int, body binary").repartition("block").mapInArrow(add, "block int, body binary")
    table = np.zeros((ORDERS * 2 << SLOT_BITS >> BLOCK_BITS, width), np.int32)
    for row in parts.collect():  # as many blocks as the constants say
        table[row["block"]] += np.frombuffer(row["body"], np.int32)
    return table.reshape(ORDERS, 2 << SLOT_BITS)


def fitted(words: DataFrame) -> dict:
    """Counters, averaged mixing weights and refinement from all training words (token, c)."""
    model = empty_model()
    model["counts"] = counted(words.select("token"))
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {**shared.value, "weights": shared.value["weights"].copy()}
        hits, seen = np.zeros((GATES, STEPS, 2)), 0
        for batch in batches:
            for part in chunks(batch.column(0).to_pylist(), 4_000):
                learn(own, part, hits)
                seen += len(part)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(seen)]), pa.array([own["weights"].tobytes()]), pa.array([hits.tobytes()])], names=["n", "weights", "hits"]
            )

    total, weights, hits = 0.0, np.zeros((GATES, ORDERS)), np.zeros((GATES, STEPS, 2))
    for row in words.select("token").mapInArrow(run, "n double, weights binary, hits binary").collect():  # one row a task
        total += row["n"]
        weights += row["n"] * np.frombuffer(row["weights"]).reshape(GATES, ORDERS)
        hits += np.frombuffer(row["hits"]).reshape(GATES, STEPS, 2)
    if total:
        model["weights"] = weights / total
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) * 24 / (STEPS - 1) - 12)))
        zero, one = model["counts"].reshape(ORDERS, 2, -1).astype(np.float32).transpose(1, 0, 2)
        model["stretched"] = stretched(zero, one)
        model["refined"] = (hits[:, :, 1] + 20 * centre) / (hits.sum(axis=2) + 20)
    return model


# ---- the document's own contexts ------------------------------------------------------------------------------------


def pointer_events(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a document's token ids: whether the pointer hit, and the probability it had (nan without a pointer)."""
    _, _, hit, p = token_mixing.pointers(np.asarray(ids, np.int64), np.zeros(len(ids), np.int64))
    return hit, p


# ---- over the tables ------------------------------------------------------------------------------------------------


def class_of(tokens: list[bytes]) -> int:
    """By the most frequent short token, the first of equals; 0 for a text without one."""
    short = Counter([t for t in tokens if 0 < len(t) <= SHORT])
    return zlib.crc32(max(short, key=short.get)) % CLASSES if short else 0


def packed_ids(ids: np.ndarray | list[int]) -> bytes:
    """Three bytes an id: all lower halves, then all upper bytes; four where a text has ids that need them.  The first byte says which."""
    x = np.asarray(ids, np.uint32)
    if x.max(initial=0) >> 24:
        return b"\4" + x.astype("<u4").tobytes()
    return b"\3" + (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype(np.uint8).tobytes()


def unpacked_ids(body: bytes) -> np.ndarray:
    if body[0] == 4:
        return np.frombuffer(body, "<u4", offset=1).astype(np.int64)
    n = len(body) // 3
    return np.frombuffer(body, "<u2", n, 1).astype(np.int64) | np.frombuffer(body, np.uint8, n, 1 + 2 * n).astype(np.int64) << 16


def coded(docs: DataFrame, key: str, text: str, folds: int, held_out: int) -> DataFrame:
    """Documents as token numbers, and the tokens these stand for; written once.

    Consecutive rows of about ``BUCKET_BYTES`` of text share a bucket, which numbers its own tokens.  Document rows have key,
    held_out, bucket, ids and size (bytes); token rows have bucket, number, token and the counts in training documents of
    each class.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (fold(key, folds) == held_out).alias("held_out"))
    kind = docs.schema[key].dataType
    classes = [f"c{k}" for k in range(CLASSES)]
    schema = T.StructType([T.StructField("key", kind)]).add("held_out", "boolean").add("bucket", "long").add("ids", "binary")
    schema = schema.add("size", "long").add("number", "integer").add("token", "binary")
    for c in classes:
        schema = schema.add(c, "integer")
    names, types = schema.fieldNames(), [to_arrow_type(f.dataType) for f in schema.fields]

    def table(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held_bytes = TaskContext.get().partitionId() << 32, 0
        number: defaultdict[bytes, int] = defaultdict()  # a new token gets the next number
        number.default_factory = number.__len__
        counts = np.zeros((CLASSES, 0), np.int64)
        seen: list[list[np.ndarray]] = [[] for _ in range(CLASSES)]  # training documents that are not counted yet

        def add_up() -> np.ndarray:
            total = np.zeros((CLASSES, len(number)), np.int64)
            total[:, : counts.shape[1]] = counts
            for k, ids in enumerate(seen):
                if ids:
                    total[k] += np.bincount(np.concatenate(ids), minlength=len(number))
                    ids.clear()
            return total

        def token_rows() -> pa.RecordBatch:
            n = len(number)
            columns = {"bucket": np.full(n, bucket), "number": np.arange(n), "token": list(number)}
            return table(columns | dict(zip(classes, add_up(), strict=True)), n)

        for batch in batches:
            keys, out = batch.column("key").to_pylist(), {c: [] for c in ("key", "held_out", "bucket", "ids", "size")}
            for k, held, t in zip(keys, batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held_bytes >= BUCKET_BYTES or len(number) >= MOST_TOKENS:
                    yield token_rows()
                    bucket, held_bytes = bucket + 1, 0
                    number.clear()
                    counts = counts[:, :0]
                tokens = tokens_of(t)
                ids = np.fromiter(map(number.__getitem__, tokens), np.uint32, len(tokens))
                if not held:
                    seen[class_of(tokens)].append(ids)
                size = len(t.encode("utf-8", "surrogatepass")) if t else 0
                held_bytes += size
                for c, v in zip(out.values(), (k, held, bucket, packed_ids(ids), size), strict=True):
                    c.append(v)
            counts = add_up()
            yield table(out, batch.num_rows)
        if number:
            yield token_rows()

    return staged(rows.mapInArrow(run, schema), "lm-coded", "zstd")


def numbered(sums: DataFrame, n_class: np.ndarray) -> DataFrame:
    """Tokens (token and class counts) with c, the cell of their code and their place in it among those of one task, part."""
    names = [f"c{k}" for k in range(CLASSES)]
    share = n_class.sum() / np.maximum(n_class, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), np.zeros(token_mixing.CELLS, np.int64)
        for batch in batches:
            counts = np.stack([batch.column(k).to_numpy() for k in names], axis=1)
            c = counts.sum(axis=1)
            lift = counts * share
            best = lift.argmax(axis=1)
            liked = lift[np.arange(len(c)), best] >= LIFT * c
            step = token_mixing.frequency_step(c)
            cell = np.where(step > 0, 16 * step + np.where(liked, best + 1, 0), 0)
            order = np.argsort(cell, kind="stable")
            here = np.bincount(cell, minlength=token_mixing.CELLS)
            place = np.empty(len(c), np.int64)
            place[order] = np.arange(len(c)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(held, here)
            held += here
            columns = [batch.column("token"), pa.array(c), pa.array(cell.astype(np.int32)), pa.array(np.full(len(c), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "c", "cell", "part", "place"])

    return staged(sums.mapInArrow(run, "token binary, c long, cell int, part int, place long"), "lm-words", "zstd")


def weighed(words: DataFrame, model: dict) -> tuple[DataFrame, dict]:
    """Tokens with c, code (0: novel) and the log10 probability of the spelling of those without a code; the cells' codes."""
    sums = words.filter("c > 0").groupBy("part", "cell").agg(F.count("*").alias("tokens"), F.sum("c").alias("c"))  # at most 136 a task
    sizes, weights, first = np.zeros(token_mixing.CELLS, np.int64), np.zeros(token_mixing.CELLS), {}
    for r in sums.orderBy("part", "cell").collect():
        first.setdefault(r["part"], np.zeros(token_mixing.CELLS, np.int64))[r["cell"]] = sizes[r["cell"]]
        sizes[r["cell"]] += r["tokens"]
        weights[r["cell"]] += r["c"]
    heads = token_mixing.heads_of(weights)
    context = words.sparkSession.sparkContext
    shared, starts = context.broadcast(model), context.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, part, place = (batch.column(k).to_numpy() for k in ("cell", "part", "place"))
            begin = np.zeros(len(cell), np.int64)
            for p in np.unique(part):
                if int(p) in starts.value:
                    begin[part == p] = starts.value[int(p)][cell[part == p]]
            code = token_mixing.codes(cell.astype(np.int64), place + begin, sizes, heads)
            spelled, log_p = np.flatnonzero(code == 0), np.zeros(len(cell), np.float32)
            for at in chunks(spelled):
                log_p[at] = spelling(shared.value, batch.column("token").take(pa.array(at)).to_pylist())
            columns = [batch.column("token"), batch.column("c"), pa.array(code), pa.array(log_p)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "c", "code", "log_p"])

    return words.mapInArrow(run, "token binary, c long, code long, log_p float"), heads


def resolved(texts: DataFrame, looked_up: DataFrame, n: int, v: int) -> DataFrame:
    """Documents as codes, written once: key, held_out, size, n_tokens, n_known, base_score, codes, spellings."""
    floor = np.log10(n + 0.5 * (v + 1))

    def per_bucket(_: tuple, texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        at = table["number"].to_numpy()
        c, code, log_p = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.float32)
        c[at], code[at], log_p[at] = table["c"], table["code"], table["log_p"]
        base = np.log10(c + 0.5) - floor
        out = []
        for doc, held, body, size in zip(texts["key"], texts["held_out"], texts["ids"], texts["size"], strict=True):
            ids = unpacked_ids(body)
            g = code[ids]
            spelled, which = np.unique(ids[g == 0], return_inverse=True)
            g[g == 0] = -1 - which
            spellings = log_p[spelled].astype("<f4").tobytes()
            out.append((doc, held, size, len(ids), int((c[ids] > 0).sum()), float(base[ids].sum()), token_mixing.packed_codes(g), spellings))
        return pd.DataFrame(out, columns=["key", "held_out", "size", "n_tokens", "n_known", "base_score", "codes", "spellings"])

    kind = texts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, size long, n_tokens long, n_known long, base_score double, codes binary, spellings binary"
    return staged(texts.groupBy("bucket").cogroup(looked_up.groupBy("of_bucket")).applyInPandas(per_bucket, schema), "lm-resolved", "zstd")


def score(docs: DataFrame, folds: int, held_out: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``, learned from the rows whose fold is not ``held_out``.

    key, held_out, n_tokens, n_known, train_tokens, base_score (smoothed frequencies), score (the model), bits_per_byte.
    """
    rows = coded(docs, key, text, folds, held_out)
    tokens = rows.filter("token IS NOT NULL")
    texts = rows.filter("ids IS NOT NULL").select("key", "held_out", "bucket", "ids", "size")
    by_class = [f"c{k}" for k in range(CLASSES)]
    n_class = np.array([x or 0 for x in tokens.agg(*[F.sum(c) for c in by_class]).first()], np.float64)
    words = numbered(tokens.groupBy("token").agg(*[F.sum(c).alias(c) for c in by_class]), n_class)
    totals = words.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    once = words.filter("c = 1").select("token")
    spelled, heads = weighed(words, fitted(once.coalesce(max(1, -(-v // WORDS_PER_TASK)))))
    looked_up = tokens.select("bucket", "number", "token").join(spelled, "token").select(F.col("bucket").alias("of_bucket"), "number", "c", "code", "log_p")
    # keys travel as text: beside a null, pandas would turn whole numbers into floats
    kind = docs.schema[key].dataType
    texts = texts.withColumn("key", F.col("key").cast("string")) if isinstance(kind, T.NumericType) else texts
    documents = resolved(texts, looked_up, n, v)
    cores = docs.sparkSession.sparkContext.defaultParallelism  # each learning task hands on a table of constant size
    model = token_mixing.fitted(documents.filter("NOT held_out").select("codes").coalesce(cores), n, heads)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            spellings = batch.column("spellings").to_pylist()
            for a, b, lengths, c in token_mixing.chunks(batch.column("codes").to_pylist(), heads):
                each = token_mixing.log_probabilities(shared.value, c)
                own = [np.frombuffer(x, "<f4") for x in spellings[a:b]]
                first = np.cumsum([0, *(len(x) for x in own)])[:-1]
                at = np.flatnonzero(c.spelled)
                each[at] += np.concatenate(own)[np.repeat(first, lengths)[at] - c.g[at] - 1]
                total[a:b] = np.add.reduceat(each, np.cumsum(lengths) - lengths)
            bits = -total * np.log2(10) / (batch.column("size").to_numpy() + 1)
            columns = {"train_tokens": pa.array(np.full(len(total), n, np.int64)), "score": pa.array(total), "bits_per_byte": pa.array(bits)}
            yield pa.RecordBatch.from_arrays([columns[k] if k in columns else batch.column(k) for k in kept], names=kept)

    schema = f"key {documents.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return documents.mapInArrow(run, schema).select(F.col("key").cast(kind).alias(key), *kept[1:])
