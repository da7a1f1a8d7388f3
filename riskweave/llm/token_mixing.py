"""Binary decisions that code a token, predicted by hashed contexts and mixed in the logistic domain.

A token of the dictionary has a code: a Huffman code of its cell (its frequency in steps of a factor of four, and the class of
texts that prefers it), then its place among the tokens of the cell.  Any other token is the code of the novel and its
spelling; if the document's pointer stands at such a token, one more bit says whether it is that one.  Every bit of every
token is an event.

Its predictors are counters, hashed by the bits so far and a context: the class that the document's tokens have voted for
so far (none at first), the last token, the last two, and the pointer's expectation with its confidence.  Weights gated by the bit's
place, by the longest context seen in training and by the pointer combine them; refinement maps the mixture to the frequency
with which such predictions came true.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PREDICTORS = 4
MOST_BITS = (21, 22, 21, 12)  # of each predictor's counters; fewer for a small corpus
PLACES = 14
KINDS = 3 * 2  # of a gate at one place
GATES = PLACES * KINDS
STEPS = 33  # of the refinement table
RATE = 0.15
CELLS = 256
HEAD = 18  # most bits of a cell's code
DECIMAL = np.float32(14)  # steps to one of an input in the logistic domain
WIDE = 62  # codes are aligned to so many bits
CHUNK = 32_768  # tokens whose contexts are made together
EVENTS_OF = 8192  # tokens whose events are made together
BLOCK_BITS = 13
EXACT = 32  # counts below are kept as they are, larger ones to 4 %
FINE = 0.08
PRIOR = np.array([0.05, 0.02, 0.3, 0.1, 0.05, 0.6, 0.4, 0.2, 0.95])  # by 3 * order + (none, missed, hit)
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD6E8FEB86659FD93)


# ---- codes ----------------------------------------------------------------------------------------------------------


def frequency_step(c: np.ndarray) -> np.ndarray:
    """1 for counts of 2 to 7, 2 for 8 to 31, and so on; 0 for a token that is spelled."""
    length = np.frexp(np.maximum(c, 1).astype(np.float64))[1]
    return np.where(c >= 2, np.minimum(15, 1 + (length - 2) // 2), 0)


def heads_of(weights: np.ndarray) -> dict:
    """Huffman codes of the cells with a weight and of the novel, cell 0: code and length of each, and the class by the first bits."""
    least = weights.sum() / 4096 + 1e-9  # bounds the length
    heap = [(max(float(w), least), i, (i,)) for i, w in enumerate(weights) if w > 0 or i == 0]
    code, length, number = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), CELLS
    heapq.heapify(heap)
    while len(heap) > 1:
        (v, _, zeros), (w, _, ones) = heapq.heappop(heap), heapq.heappop(heap)
        code[list(ones)] |= np.int64(1) << length[list(ones)]
        length[[*zeros, *ones]] += 1
        number += 1
        heapq.heappush(heap, (v + w, number, zeros + ones))
    classes = np.zeros(1 << HEAD, np.uint8)
    for cell in heap[0][2]:
        first = code[cell] << (HEAD - length[cell])
        classes[first : first + (1 << (HEAD - length[cell]))] = cell % 16
    return {"code": code, "length": length, "classes": classes}


def codes(cell: np.ndarray, place: np.ndarray, sizes: np.ndarray, heads: dict) -> np.ndarray:
    """A one, then the bits of the code, for cells 16 * frequency + class of the given ``sizes``; 0 where a token is novel."""
    more = np.frexp(np.maximum(sizes - 1, 0).astype(np.float64))[1].astype(np.int64)
    head = (np.int64(1) << heads["length"]) | heads["code"]
    return np.where(cell < 16, 0, (head[cell] << more[cell]) | place)


def packed_codes(g: np.ndarray) -> bytes:
    """Codes, spelled tokens as negative numbers, in four or eight bytes, as planes of equal bytes; the first byte says which."""
    width = 4 if not len(g) or (g.max() < 2**31 and g.min() >= -(2**31)) else 8
    return bytes([width]) + g.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked_codes(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(body[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<i{body[0]}").ravel().astype(np.int64)


# ---- the document's own contexts ------------------------------------------------------------------------------------


def in_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by (key, position), and where in that order a new key begins."""
    n, bits = len(keys), len(keys).bit_length()
    if n and 0 <= keys.min() and int(keys.max()) >> (63 - bits) == 0:
        both = np.sort((keys << bits) | np.arange(n))
        order, held = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(keys, kind="stable")
        held = keys[order]
    return order, np.concatenate([[True], held[1:] != held[:-1]]) if n else np.empty(0, bool)


def pointers(keys: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of documents laid end to end (``start``: where each token's document begins): the earlier position the
    pointer stands at or -1, the order of its context, whether it hits, and the probability that it does (nan without one).
    """
    n = len(keys)
    if n and keys.max() >> 32:
        keys = np.unique(keys, return_inverse=True)[1]
    at = np.arange(n)
    since = at - start
    document = np.cumsum(since == 0) - 1
    last = np.concatenate([[0], keys[:-1]])[:n]
    target, order = np.full(n, -1), np.full(n, -1)
    first = since > 0
    target[first], order[first] = at[first] - 1, 0
    contexts = (document << 33) | np.where(first, last + 1, 0)
    for k in (1, 2):
        sorted_at, new = in_groups(contexts)
        before = np.full(n, -1)
        before[sorted_at[1:]] = np.where(new[1:], -1, sorted_at[:-1])
        known = (before >= 0) & (since > k)
        target[known], order[known] = before[known], k
        if k == 1:  # the pair of the last two contexts tells the last two tokens and the document
            number = np.empty(n, np.int64)
            number[sorted_at] = np.cumsum(new) - 1
            contexts = number * (n + 1) + np.concatenate([[n], number[:-1]])[:n]
    has = order >= 0
    hit = has & (keys[target] == keys)
    state = np.where(has, 1 + hit, 0)
    gate = 3 * order + np.where(first, np.concatenate([[0], state[:-1]])[:n], 0)
    p, where = np.full(n, np.nan), np.flatnonzero(has)
    sorted_at, new = in_groups(document[where] * 9 + gate[where])
    hits = hit[where][sorted_at]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))
    sums = np.cumsum(hits) - hits
    p[where[sorted_at]] = (sums - sums[begin] + 2 * PRIOR[gate[where][sorted_at]]) / (np.arange(len(where)) - begin + 2)
    return target, order, hit, p


class Contexts:
    """Codes and hashed contexts of the tokens of some documents; ``lengths`` of each in tokens, novel ones below 0."""

    def __init__(self, g: np.ndarray, lengths: np.ndarray, heads: dict):
        n, self.g = len(g), g
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        since = np.arange(n) - start
        novel, whole = g < 0, np.where(g < 0, 1, g)
        length = np.frexp(whole.astype(np.float64))[1] - np.int64(1)
        aligned = (whole ^ (np.int64(1) << length)) << (WIDE - length)  # the first bit of a code is the same of all
        target, order, hit, p = pointers(np.where(novel, -2 * g + 1, 2 * g), start)
        has = order >= 0
        onto = novel[target] & has
        head, bits = heads["code"][0], heads["length"][0]
        flag = np.int64(1) << (WIDE - 1 - bits)
        self.spelled = novel & ~hit
        self.code = np.where(novel, (head << (WIDE - bits)) | np.where(hit, flag, 0), aligned)
        self.length = np.where(novel, bits + onto, length)
        # the pointer's code, and how many bits of it are those of the token
        self.expected = np.where(onto, (head << (WIDE - bits)) | flag, aligned[target])
        common = WIDE - np.frexp((self.expected ^ self.code).astype(np.float64))[1]
        self.agreed = np.where(has, np.minimum(common, np.where(onto, bits, length[target] - 1)), -1)
        trust = np.clip(np.nan_to_num(p, nan=0.5), 1e-4, 1 - 1e-4)
        trust = np.rint(np.clip(np.log(trust / (1 - trust)) + 7, 0, 15)).astype(np.int64)
        self.trust = np.where(has, 1 + order * 16 + trust, 0) * 64
        # the class with most votes so far, 0 before the first
        own = np.where(novel, 0, heads["classes"][aligned >> (WIDE - HEAD)])
        most, voted = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in np.unique(own[own > 0]).tolist():
            votes = np.cumsum(own == k) - (own == k)
            votes -= votes[start]
            voted[votes > most] = k
            np.maximum(most, votes, out=most)
        seen = whole.astype(np.uint64)
        last = np.where(since > 0, np.concatenate([[0], seen[:-1]])[:n], 0).astype(np.uint64)
        last2 = np.where(since > 1, np.concatenate([[0, 0], seen[:-2]])[:n], 0).astype(np.uint64)
        parts = (voted.astype(np.uint64), last, last * FACTOR + last2)
        self.hashed = []
        for k, c in enumerate(parts):
            h = (c + np.uint64(k + 1)) * MIX
            self.hashed.append((h ^ (h >> np.uint64(31))) * FACTOR)


def chunks(bodies: list[bytes], heads: dict) -> Iterator[tuple[int, int, np.ndarray, Contexts]]:
    """Documents a to b, their lengths and contexts, some ``CHUNK`` tokens at a time."""
    a, held, size = 0, [], 0
    for b, body in enumerate(bodies, 1):
        held.append(unpacked_codes(body))
        size += len(held[-1])
        if size >= CHUNK or b == len(bodies):
            lengths = np.array([len(x) for x in held])
            yield a, b, lengths, Contexts(np.concatenate(held), lengths, heads)
            a, held, size = b, [], 0


# ---- events ---------------------------------------------------------------------------------------------------------


def sizes_for(tokens: int) -> list[int]:
    """Bits of each predictor's counters: two slots a token, within their bounds."""
    return [min(most, max(12, tokens.bit_length() + 1)) for most in MOST_BITS]


def planes(c: Contexts, a: int, b: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The events of tokens a to b, one place in the code after the other: the place, the tokens that have a bit there, the
    bits, and the slot of each predictor among its own counters.  Tokens come in the same order at every place."""
    order = np.argsort(-c.length[a:b], kind="stable") + a
    having = np.cumsum(np.bincount(c.length[a:b])[::-1])[::-1]  # tokens of at least so many bits
    code, expected, agreed, trust = c.code[order], c.expected[order], c.agreed[order], c.trust[order]
    hashed = [h[order] for h in c.hashed]
    for place in range(len(having) - 1):
        m = having[place + 1]
        node = code[:m] >> (WIDE - 1 - place)
        bit = node & 1
        node >>= 1
        node |= 1 << place
        node = node.view(np.uint64)
        node *= FACTOR
        slots = []
        for h, bits in zip(hashed, sizes, strict=False):
            x = h[:m] ^ node
            x *= MIX
            x >>= np.uint64(64 - bits)
            slots.append(x.view(np.int64))
        x = expected[:m] >> (WIDE - 1 - place)
        x &= 1
        x *= 32
        x += trust[:m]
        x += min(place, 31)
        x *= agreed[:m] >= place
        slots.append(x)
        yield place, order[:m], bit, slots


def count_values() -> np.ndarray:
    codes = np.arange(256)
    return np.where(codes < EXACT, codes, EXACT * np.exp((codes - EXACT) * FINE))


def states(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Both counts of a slot in two bytes."""
    both = []
    for x in (zero, one):
        far = EXACT + np.rint(np.log(np.maximum(x, EXACT) / EXACT) / FINE)
        both.append(np.where(x < EXACT, x, np.minimum(far, 255)).astype(np.uint16))
    return both[0] | both[1] << 8


def stretches() -> np.ndarray:
    """``DECIMAL`` times the state in the logistic domain as it is, and without one zero or one one; exactly 0 where there are no counts."""
    v = count_values()
    less = np.maximum(v - 1, 0)
    pairs = ((v, v), (less, v), (v, less))
    exact = np.concatenate([np.log((one[:, None] + 0.2) / (zero[None, :] + 0.2)).ravel() for zero, one in pairs])
    return np.rint(exact * DECIMAL).clip(-127, 127).astype(np.int8)


def empty_model(tokens: int, heads: dict) -> dict:
    sizes = sizes_for(tokens)
    return {
        "sizes": sizes,
        "heads": heads,
        "states": [np.zeros(1 << s, np.uint16) for s in sizes],
        "weights": np.full((GATES, PREDICTORS), 0.3),
        "refined": None,
    }


def mixed(model: dict, place: int, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of gate and mixture of the events of one place; ``inputs``: a row for each predictor."""
    m = inputs.shape[1]
    known = np.maximum((inputs[1] != 0).view(np.uint8), (inputs[2] != 0).view(np.uint8) * np.uint8(2))
    kind = (known * np.uint8(2) + (inputs[3] != 0)).astype(np.int64)
    at = min(place, PLACES - 1) * KINDS
    of_kind = (model["weights"][at : at + KINDS] / DECIMAL).astype(np.float32) @ inputs
    x = of_kind.ravel().take(kind * m + np.arange(m))
    return kind, np.clip(x, -12, 12, out=x)


def refine_cell(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of the cells of one place."""
    cell = np.rint((x + np.float32(12)) * np.float32((STEPS - 1) / 24)).astype(np.int64)
    cell += kind * STEPS
    return cell


def learn(model: dict, c: Contexts, hits: np.ndarray) -> None:
    """One pass over the tokens: every bit's error moves the weights of its gate, ``hits`` [place, kind and cell, bit] counts
    outcomes.  The errors of the bits at one place in ``EVENTS_OF`` tokens are taken with the same weights.
    """
    for a in range(0, len(c.code), EVENTS_OF):
        for place, _, bit, slots in planes(c, a, min(a + EVENTS_OF, len(c.code)), model["sizes"]):
            left_out = (1 + bit) << 16
            inputs = np.empty((PREDICTORS, len(bit)), np.float32)
            for k, (s, states_of) in enumerate(zip(slots, model["states"], strict=True)):
                inputs[k] = model["stretch"].take(states_of.take(s) | left_out)
            kind, x = mixed(model, place, inputs)
            p = 1 / (1 + np.exp(-x))
            inputs /= DECIMAL
            here = (kind == np.arange(KINDS)[:, None]).astype(np.float32)
            moved = (here * (bit.astype(np.float32) - p)) @ inputs.T
            slope = (here * (p * (1 - p))) @ (inputs * inputs).T
            at = min(place, PLACES - 1)
            model["weights"][at * KINDS : (at + 1) * KINDS] += RATE * np.clip(moved / (slope + 5), -1, 1)
            hits[at] += np.bincount(refine_cell(kind, x) * 2 + bit, minlength=hits[at].size).reshape(hits[at].shape)


def log_probabilities(model: dict, c: Contexts) -> np.ndarray:
    """Log10 probability of each token's bits."""
    out = np.zeros(len(c.code))
    for a in range(0, len(out), EVENTS_OF):
        total, tokens = np.ones(min(EVENTS_OF, len(out) - a)), np.empty(0, np.int64)
        for place, token, bit, slots in planes(c, a, a + len(total), model["sizes"]):
            inputs = np.empty((PREDICTORS, len(bit)), np.float32)
            for k, (s, of) in enumerate(zip(slots, model["inputs"], strict=True)):
                inputs[k] = of.take(s)
            kind, x = mixed(model, place, inputs)
            zero = (1 - bit).astype(np.float32)
            p = 1 / (1 + np.exp(x * (2 * zero - 1)))
            if model["refined"] is not None:
                p += np.abs(zero - model["refined"][min(place, PLACES - 1)].take(refine_cell(kind, x)))
                p /= 2
            total[: len(bit)] *= p  # at most 48 bits of at least 3e-6
            tokens = token if not place else tokens
        out[tokens] = np.log10(total[: len(tokens)])
    return out


# ---- over the tables ------------------------------------------------------------------------------------------------


def counted(documents: DataFrame, sizes: list[int], heads: dict) -> list[np.ndarray]:
    """States of all counters from the bits of all training tokens; the counts are summed by block on Spark."""
    total, width = sum(1 << s for s in sizes), 1 << BLOCK_BITS
    firsts = np.cumsum([0, *(1 << s for s in sizes)]).tolist()
    skipped = firsts[-2]  # the slot of no expectation

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * total, np.int32)
        for batch in batches:
            for _, _, _, c in chunks(batch.column(0).to_pylist(), heads):
                for a in range(0, len(c.code), EVENTS_OF):
                    for _, _, bit, slots in planes(c, a, min(a + EVENTS_OF, len(c.code)), sizes):
                        for s, first in zip(slots, firsts, strict=False):
                            s *= 2
                            s += bit
                            np.add.at(table[2 * first :], s, np.int32(1))
        table[2 * skipped : 2 * skipped + 2] = 0
        for i in range(0, 2 * total, width):
            block = table[i : i + width]
            if block.any():
                body = pa.compress(block.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([body])], names=["block", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = pa.decompress(body, 4 * width, codec="zstd", asbytes=True)
                sums[i] = sums.get(i, 0) + np.frombuffer(block, np.int32).astype(np.int64)
        for i, block in sums.items():
            body = states(block[0::2], block[1::2]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([body])], names=["block", "body"])

    schema = "block long, body binary"
    out = np.zeros(total, np.uint16)
    for row in documents.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():  # as many blocks as the constants say
        body = np.frombuffer(row["body"], np.uint16)
        out[row["block"] // 2 : row["block"] // 2 + len(body)] = body
    return [out[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]


def fitted(documents: DataFrame, tokens: int, heads: dict) -> dict:
    """Counters, mixing weights averaged over tasks, and refinement from every bit of the training documents (codes)."""
    model = empty_model(tokens, heads)
    if not tokens:
        return model | {"inputs": [x.astype(np.int8) for x in model.pop("states")]}
    model["states"] = counted(documents, model["sizes"], heads)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {**shared.value, "weights": shared.value["weights"].copy(), "stretch": stretches()}
        hits, seen = np.zeros((PLACES, KINDS * STEPS, 2)), 0
        for batch in batches:
            for _, _, _, c in chunks(batch.column(0).to_pylist(), own["heads"]):
                learn(own, c, hits)
                seen += len(c.code)
        if seen:
            columns = [pa.array([float(seen)]), pa.array([own["weights"].tobytes()]), pa.array([hits.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "weights", "hits"])

    total, weights, hits = 0.0, np.zeros((GATES, PREDICTORS)), np.zeros((PLACES, KINDS * STEPS, 2))
    for row in documents.mapInArrow(run, "n double, weights binary, hits binary").collect():  # one row a task; an iterator would run one task at a time
        total += row["n"]
        weights += row["n"] * np.frombuffer(row["weights"]).reshape(weights.shape)
        hits += np.frombuffer(row["hits"]).reshape(hits.shape)
    if total:
        model["weights"] = weights / total
        centre = np.tile(1 / (1 + np.exp(-(np.arange(STEPS) * 24 / (STEPS - 1) - 12))), KINDS)
        model["refined"] = ((hits[:, :, 1] + 20 * centre) / (hits.sum(axis=2) + 20)).astype(np.float32)
    plain = stretches()[: 1 << 16]
    return model | {"inputs": [plain[x] for x in model.pop("states")]}
