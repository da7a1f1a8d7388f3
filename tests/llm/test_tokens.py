"""Tokens as bits: codes, a distribution over the next token, contexts across words, counters of every training bit."""

from __future__ import annotations

import zlib

import numpy as np

from riskweave.llm import context_mixing, token_mixing

SIZES = np.zeros(token_mixing.CELLS, np.int64)
SIZES[[16, 17, 33]] = 4, 8, 1
HEADS = token_mixing.heads_of(np.where(np.arange(token_mixing.CELLS) == 0, 5.0, SIZES))


def vocabulary() -> np.ndarray:
    cell = np.repeat(np.arange(token_mixing.CELLS), SIZES)
    place = np.concatenate([np.arange(n) for n in SIZES])
    return token_mixing.codes(cell, place, SIZES, HEADS)


def documents(seed: int, n: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    words = [*vocabulary().tolist(), -1, -2]
    return [np.array(r.choice(words, r.integers(1, 40))) for _ in range(n)]


def test_codes_are_free_of_prefixes_and_bounded():
    code = ["".join(bin(x)[3:]) for x in vocabulary()]
    novel = format(HEADS["code"][0], f"0{HEADS['length'][0]}b")
    assert sum(2.0 ** -len(x) for x in [*code, novel]) == 1 and len({*code, novel}) == len(code) + 1
    steep = token_mixing.heads_of(1.7 ** np.arange(token_mixing.CELLS))
    assert 0 < steep["length"].max() <= token_mixing.HEAD and (2.0 ** -steep["length"]).sum() == 1
    g = np.array([300, -1, 2**31 - 1, -(2**31)])
    for x in (g, np.append(g, 2**40), g[:0]):
        assert token_mixing.unpacked_codes(token_mixing.packed_codes(x)).tolist() == x.tolist()


def contexts(docs: list[np.ndarray]) -> token_mixing.Contexts:
    return token_mixing.Contexts(np.concatenate(docs), np.array([len(x) for x in docs]), HEADS)


def test_next_token_has_a_distribution():
    r = np.random.default_rng(3)
    model = token_mixing.empty_model(1000, HEADS)
    model["inputs"] = [r.integers(-30, 30, 1 << s).astype(np.int8) for s in model["sizes"]]
    for before in documents(1, 12):
        told = {before[k] for k in range(len(before)) if before[k] < 0}
        last = [*vocabulary().tolist(), *told, -9]  # -9 is new in the document
        c = contexts([np.append(before, x) for x in last])
        ends = np.cumsum([len(before) + 1] * len(last)) - 1
        p = 10 ** token_mixing.log_probabilities(model, c)[ends]
        novel = np.array(last) < 0  # those that the pointer does not stand at share the probability of a novel token
        hit = novel & ~c.spelled[ends]
        assert np.isclose(p[~novel].sum() + p[hit].sum() + p[-1], 1, atol=1e-5) and hit.sum() <= 1


def test_documents_do_not_see_each_other():
    docs = documents(2, 30)
    model = token_mixing.empty_model(1000, HEADS)
    model["inputs"] = [np.random.default_rng(5).integers(-30, 30, 1 << s).astype(np.int8) for s in model["sizes"]]
    alone = np.concatenate([token_mixing.log_probabilities(model, contexts([x])) for x in docs])
    assert np.allclose(token_mixing.log_probabilities(model, contexts(docs)), alone, rtol=1e-5)


def test_counters_hold_every_training_bit(spark):
    docs = documents(4, 50)
    frame = spark.createDataFrame([(bytearray(token_mixing.packed_codes(x)),) for x in docs], "codes binary").repartition(3)
    sizes = token_mixing.sizes_for(1000)
    got, c = token_mixing.counted(frame, sizes, HEADS), contexts(docs)
    want = [np.zeros((1 << s, 2), np.int64) for s in sizes]
    for _, _, bit, slots in token_mixing.planes(c, 0, len(c.code), sizes):
        for table, s in zip(want, slots, strict=True):
            for at, b in zip(s, bit, strict=True):
                table[at, b] += 1
    assert all(table.sum() == c.length.sum() for table in want)
    want[-1][0] = 0
    assert all((token_mixing.states(w[:, 0], w[:, 1]) == g).all() for w, g in zip(want, got, strict=True))


def test_the_last_word_tells_the_next(spark):
    """Two held-out texts of the same words in another order: the words seen in this order in training are likelier."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    taught = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    r = np.random.default_rng(7)
    pairs = [f"first{k} second{k}" for k in range(16)]
    rows = [(i, " ".join(r.choice(pairs, 12))) for i in taught]
    rows += [(held[0], "first1 second1 first2 second2"), (held[1], "first1 second2 first2 second1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in context_mixing.score(docs, 5, 1).collect()}
    right, wrong = got[held[0]], got[held[1]]
    assert abs(right.base_score - wrong.base_score) < 1e-9 and right.score > wrong.score + 2
    assert right.score > right.base_score + 1.5  # two of five tokens are told by the word before
