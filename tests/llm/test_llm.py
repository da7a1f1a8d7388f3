"""The corpus operators against brute-force versions, libraries and planted cases; edge rows for every operator."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from riskweave.llm import (
    bit_sliced,
    context_mixing,
    neural_partitions,
    ngram_join,
    packing,
    privacy,
    quality,
    secrets,
    sentence_pieces,
    toxicity,
)
from riskweave.llm.components import components
from riskweave.llm.tables import table

DOC = "doc_id long, text string, lang string, source string, n_chars long, row_id string, score string, sig string, bucket string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    near = words(1, 60)
    texts = [
        (1, near), (2, near), (2, near), (3, near + " tail"), (4, words(2, 50)), (5, ""), (6, None), (None, near), (None, None),
        (7, "one two"), (8, "one two"), (9, "x" * 20000), (10, "She paid +1 (202) 555-0136 token = 'abcd1234efgh' me@a.bc " + words(3, 9000)),
        (11, " \n\t "),
    ]
    rows = [(i, t, None, None if i == 4 else "src", None, "a", "b", "c", "d") for i, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- 1 ----


def brute_join(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    distinct = list({s for _, s in sets if s})
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = {s: {t for t in distinct if t != s and like(s, t)} for s in distinct}
    out = []
    for i, s in sets:
        if s is None:
            out.append((i, i, 0, 1))
            continue
        group, todo = {s}, [s]
        while todo:
            for t in links[todo.pop()] - group:
                group.add(t)
                todo.append(t)
        keys = [k for k, t in sets if t in group and k is not None]
        out.append((i, min(keys) if keys else None, len(links[s]), sum(t == s for _, t in sets)))
    return sorted(out, key=str)


def test_join_matches_brute_force_on_odd_rows(odd):
    got = [tuple(r) for r in ngram_join.similarity_join(odd).collect()]
    assert sorted(got, key=str) == brute_join([(r.doc_id, r.text) for r in odd.collect()])


def test_join_matches_brute_force_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = [tuple(r) for r in entry.queries()["op1_ngram_jaccard_join"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == brute_join([(r.doc_id, r.text) for r in docs.collect()])


def test_join_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    base = words(9, 80).split()
    rows = []
    for i in range(30):
        w = list(base)
        w[(7 * i) % 80] = f"new{i}"
        if i % 3 == 0:
            w[(7 * i + 40) % 80] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(50 + i, 40)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.similarity_join(docs).collect()]
    assert sorted(got, key=str) == brute_join(rows)


def test_bayesian_decisions_keep_pairs_at_the_threshold():
    fewest = ngram_join.fewest_agreements()
    assert all(a <= b for a, b in zip(fewest.values(), list(fewest.values())[1:], strict=False))
    agreements = np.random.default_rng(1).binomial(96, 0.8, 100_000)
    assert (agreements < fewest[96]).mean() < 1e-3
    assert (np.random.default_rng(1).binomial(96, 0.3, 10_000) >= fewest[96]).mean() < 1e-3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


# ---- 2 ----


def test_pieces_equal_the_library(spark, sf_dir):
    library = SentencePieceProcessor(model_file=PIECE_BPE)
    rows = entry.queries()["op2_sentence_pieces"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(texts)
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip and r.n_pieces == len(r.ids) for r in rows)


def test_pieces_of_odd_strings():
    library, pieces = SentencePieceProcessor(model_file=PIECE_BPE), sentence_pieces.Pieces(PIECE_BPE)
    r = random.Random(4)
    parts = [*"abe é\n\t▁漢字ß", "  ", "   ", "\U0001f600", "\x00", "the", "ing", " the", "٣", "̈", "<s>", "<unk>", "<0x0A>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    for t, coded in zip(texts, sentence_pieces.encode_batch(pieces, texts), strict=True):
        ids = np.frombuffer(coded, "<i4").tolist()
        assert ids == library.encode(t)
        assert sentence_pieces.decode_ids(pieces, ids) == t.replace("▁", " ")


def test_best_sums_are_best():
    pieces = sentence_pieces.Pieces(PIECE_BPE, "sums")
    pieces.scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.5, "▁a": -4.0, "bab": -4.0, "abab": -9.0}
    pieces.ids = {p: i for i, p in enumerate(pieces.scores)}
    pieces.prefixes = {p[:k] for p in pieces.scores for k in range(1, len(p) + 1)}

    def best(word):
        return max((pieces.scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces.scores), default=-1e18) if word else 0.0

    for n in range(1, 9):
        for m in range(2**n):
            word = "▁" + "".join("ab"[m >> i & 1] for i in range(n))
            ids = np.frombuffer(pieces.segmented([word])[word], "<i4")
            by_id = {i: p for p, i in pieces.ids.items()}
            assert "".join(by_id[i] for i in ids) == word
            assert sum(pieces.scores[by_id[i]] for i in ids) == best(word)


def test_pieces_on_odd_rows(odd, empty):
    coded = sentence_pieces.decode(sentence_pieces.encode(odd, PIECE_BPE, out="row ids"), PIECE_BPE, "row ids", "back")
    for r in coded.collect():
        assert r.back == (r.text or "") and bool(r["row ids"]) == bool(r.text)
    assert sentence_pieces.encode(empty, PIECE_BPE).count() == 0


# ---- 3 and 9 ----


def spans_string(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def plain_secrets(text):
    assign = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def plain_personal(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] * all(int(x) <= 255 for x in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        found += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and check % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] * (9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return found


@pytest.mark.parametrize(
    ("name", "kinds", "plain"),
    [("op3_secret_scan", secrets.KINDS, plain_secrets), ("op9_personal_data", privacy.KINDS, plain_personal)],
)
def test_span_queries_match_plain_patterns(spark, sf_dir, name, kinds, plain):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(spans_string(base, kinds).encode()).hexdigest()
        assert set(spans_string(base, kinds).split(",")) <= set(r.spans.split(","))
        for i, kind in enumerate(kinds[:-1]):
            assert r[f"n_{kind}"] == sum(k == i for _, k, _ in base)


def test_patterns_on_random_strings():
    r = random.Random(3)
    for alphabet, plain, own in [
        (["token", "=", " ", "a1b2c3d4", "'", ":", "secret", "AKIA", "ZZ99" * 3, "ſecret", "0f" * 16], plain_secrets, lambda t: [s for s, _ in secrets.base_matches(t)]),
        (list("ab@.-1 +()_") + ["255", "4111 1111 1111 1111", "1.2.3"], plain_personal, privacy.base_spans),
    ]:
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25)))
            assert sorted(own(t)) == sorted(plain(t)), t


def test_ownership_separates_examples_from_credentials(spark):
    shown, own = "token = q7Fz0Lm2Xc9VbN4k", "token = Zk81mQp0Yt5Wc3Rs"
    loose = "p9Rk2LmX7vQa4Zt8WcYb1N"
    rows = [(i, f"see {shown} here", f"s{i}") for i in range(5)] + [(9, f"mine {own} and {loose} end", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[0].n_copied == 1 and got[0].n_owned == 0 and got[9].n_owned == 2 and got[9].n_copied == 0
    assert got[9].spans.count("token:") == 1 and "token:" not in got[0].spans
    texts = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert texts[0] == rows[0][1] and texts[9] == "mine <secret> and <secret> end"


def test_terms_that_disclose_are_added(spark):
    rows = [(i, f"call Zaphod now +1 (202) 555-0136 please {words(i, 30)}") for i in range(3)]
    rows += [(10 + i, f"please call now {words(100 + i, 30)}") for i in range(60)]
    got = {r.doc_id: r for r in privacy.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:5:11" in got[0].spans and got[0].n_term == 1 and got[10].n_term == 0


def test_terms_disclose_over_whole_documents_and_in_all_of_them(spark, odd, empty):
    """An entity of one document, a short name and a code far from it, in this and in another document; brute force."""
    far = "call please now " * 40
    rows = [(1, f"Bo paid me@a.bc {far} bo and x7 again Zed"), (2, f"x7 {far}"), (3, f"+1 (202) 555-0136 Ann {far}"), (4, f"ann 202-5550136 +12025550136 {far}")]
    rows += [(10 + i, f"{far} paid and again") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.scan(docs).collect()}
    texts = dict(rows)
    spans = {i: privacy.base_spans(t) for i, t in rows}
    terms = {i: {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if all(m.end() <= a or b <= m.start() for a, _, b in spans[i])} for i, t in rows}
    held = {i: {privacy.entity_hash(k, texts[i][a:b]) for a, k, b in s} for i, s in spans.items()}
    n, wanted = len(rows), set()
    for c in set().union(*held.values()):
        those = [i for i in held if c in held[i]]
        for t in set().union(*(terms[i] for i in those)):
            both, n_t = sum(t in terms[i] for i in those), sum(t in x for x in terms.values())
            if both >= min(2, len(those)) and np.log(n * both / (len(those) * n_t)) >= 0.8 * np.log(n / len(those)) - 1e-12:
                wanted.add(t)
    assert {"bo", "x7", "zed", "ann"} <= wanted and not {"call", "paid"} & wanted
    for i, t in rows:
        add = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in wanted and all(m.end() <= a or b <= m.start() for a, _, b in spans[i])]
        every = spans_string(spans[i] + add, privacy.KINDS)
        assert got[i].n_term == len(add) and (got[i].spans, got[i].elsewhere) == ((every, "") if spans[i] else ("", every))
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[1] == f"<term> paid <email> {far} <term> and <term> again <term>" and clean[2] == f"<term> {far}" and clean[10] == rows[-1][1]
    done = privacy.sanitise(odd)
    assert done.columns == odd.columns and done.count() == odd.count() and privacy.sanitise(empty).count() == 0
    assert not done.filter("text LIKE '%me@a.bc%' OR text LIKE '%555-0136%'").count()


def test_span_operators_on_odd_rows(odd, empty):
    for scan in (secrets.scan, privacy.scan):
        rows = scan(odd).collect()
        assert len(rows) == odd.count()
        assert {r.spans for r in rows if r.doc_id in (5, 6)} == {""}
        assert scan(empty).count() == 0
    assert secrets.redacted(odd).columns == odd.columns and secrets.redacted(odd).count() == odd.count()
    assert privacy.sanitised("a bc d", [(2, "term", 4)]) == "a <term> d"


# ---- 4 ----


def test_language_model_base_and_probabilities(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    count, train = {}, 0
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""] for i, t in docs}
    for i, ts in tokens.items():
        if not held[i]:
            for t in ts:
                count[t] = count.get(t, 0) + 1
                train += 1
    floor = np.log10(train + 0.5 * (len(count) + 1))
    rows = entry.queries()["op4_context_mixing"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        c = np.array([count.get(t, 0) for t in tokens[r.doc_id]])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(c), (c > 0).sum(), train)
        assert abs(r.base_score - (np.log10(c + 0.5) - floor).sum()) < 1e-6
        assert np.isfinite(r.score) and r.score < 0


def test_spelling_is_a_distribution():
    model = context_mixing.empty_model()
    two = [bytes([a]) for a in range(256) if a != 32]
    heads = 10 ** context_mixing.spelling(model, [b""])
    assert 0 < heads[0] < 1 and (10 ** context_mixing.spelling(model, two)).sum() < 1


def test_pointers_find_repetition():
    hit, p = context_mixing.pointer_events(np.array([1, 2, 3, 1, 2, 3, 1, 2, 3]))
    assert hit[4:].all() and not hit[:3].any() and np.isnan(p[0]) and p[8] > p[4]


def test_language_model_on_odd_rows(odd, empty):
    rows = context_mixing.score(odd, 5, 1).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (5, 6, 11))
    assert context_mixing.score(empty, 5, 1).count() == 0


# ---- 5 and 10 ----


@pytest.mark.parametrize(("learner", "label", "folds", "held_out", "least"), [(toxicity, "toxic", 5, 0, 0.9), (quality, "quality", 3, 1, 0.9)])
def test_classifiers_on_held_out_rows(spark, learner, label, folds, held_out, least):
    big = "/root/testdata/sf0.1"
    name = {"toxic": "op5_toxicity", "quality": "op10_quality_classifier"}[label]
    rows = entry.queries()[name](spark, big)
    judged = rows.join(table(spark, big, "labels"), "doc_id").filter("held_out")
    right = judged.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right > least
    assert rows.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").isEmpty()
    assert rows.filter(f"held_out <> (crc32(CAST(doc_id AS STRING)) % {folds} = {held_out})").isEmpty()


@pytest.mark.parametrize("learner", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, empty, learner):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (7, 1), (None, 1), (9, None), (10, 2)], "doc_id long, y int")
    model = learner.train(odd, labels, "y", 5, 9)
    rows = learner.score(odd, model, out="points").collect()
    assert len(rows) == odd.count() and all(0 <= r.points <= 1 for r in rows)
    assert len({r.points for r in rows if not (r.text or "").strip()}) == 1
    nothing = learner.train(empty, labels.limit(0), "y", 5, 9)
    assert learner.score(empty, nothing, out="points").count() == 0


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    r = np.random.default_rng(2)
    rows = lambda n, toxic: [(np.unique(np.append(r.integers(100, 900, 20), [5] * toxic)).astype(np.int64), np.ones(0)) for _ in range(n)]
    ones = lambda xs: [(i, np.ones(len(i))) for i, _ in xs]
    w, b = toxicity.non_negative_pu(ones(rows(200, 1)), ones(rows(900, 0) + rows(100, 1)), 0.1, 10)
    assert w[5] + b > 0 > b


# ---- 6 and 8 ----


def odd_vectors(spark, n=300, dim=8):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(0, 0.4, dim).astype(np.float32).tolist(), "x") for i in range(n)]
    rows += [(n + i, [0.25] * dim, "x") for i in range(60)]
    rows += [(1000, None, "x"), (1100, [], "x"), (1200, [float("nan")] * dim, "x"), (1300, [None] + [0.5] * (dim - 1), "x")]
    rows += [(1400, [float("inf")] * dim, "x"), (1500, [0.0] * dim, "x"), (None, [0.1] * dim, "x"), (1600, [0.3] * 3, "x"), (1700, [0.4] * 3, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4), rows


def test_bit_sliced_equals_plain_products(spark):
    frame, rows = odd_vectors(spark)
    use = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in use:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in use if i != q and len(y) == len(x))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [tuple(r) for r in bit_sliced.top_k(frame, F.col("vec_id") % 20 == 0, 10).collect()]
    assert sorted(got) == sorted(want)
    assert bit_sliced.top_k(frame.limit(0), F.col("vec_id") % 20 == 0, 10).count() == 0


def test_learned_partitions_recall(spark):
    big = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table(spark, big, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in entry.queries()["op8_nearest_neighbours"](spark, big).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        found = got[ids[i]]
        assert len(found) == 20 and all(abs(found[k][1] - x[i] @ x[ids == found[k][0]][0]) < 1e-12 for k in found)
        hits += len({ids[j] for j in best} & {v for v, _ in found.values()})
        total += 20
    assert hits / total >= 0.9


def test_learned_partitions_on_odd_rows(spark):
    frame, rows = odd_vectors(spark)
    got = neural_partitions.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    left_out = {1000, 1100, 1200, 1300, 1400, 1500, None}
    assert not left_out & {r.query_id for r in got} and not left_out & {r.vec_id for r in got}
    assert [r.vec_id for r in got if r.query_id == 1600] == [1700]
    same = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 300 and abs(r.score - 0.5) < 1e-9]
    assert same == sorted(same)
    assert neural_partitions.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


# ---- 7 ----


def test_packing_covers_every_id_once(spark, sf_dir):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in table(spark, sf_dir, "documents").collect()}
    rows = entry.queries()["op7_packing"](spark, sf_dir).collect()
    check_packing(rows, ids)
    used = sum(r.length for r in rows)
    assert used / (4096 * len({r.sequence_id for r in rows})) > 0.98


def check_packing(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
    assert by_doc.keys() == ids.keys()
    for parts, at in [*((p, "start") for p in by_doc.values()), *((p, "offset") for p in by_sequence.values())]:
        end = 0
        for r in sorted(parts, key=lambda r: r[at]):
            assert r[at] == end
            end += r.length
        assert end <= 4096 or at == "start"


def test_word_ids_equal_the_tokenizer():
    tokenizer, own, r = Tokenizer.from_file(WORD_BPE), packing.WordIds(WORD_BPE), random.Random(5)
    parts = [*"aAsS'eé9 \n\t.,!|", "́", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "ﬁ", "'re", "'LL", "漢", "...", "½"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(own.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = sorted(np.random.default_rng(4).integers(1, 4097, 500).tolist(), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(room, -i) for i, room in enumerate(rooms) if room >= n]
        room, i = min(fits) if fits else (4096, -len(rooms))
        want.append(4096 - room)
        if fits:
            rooms[-i] -= n
        else:
            rooms.append(4096 - n)
    placed = packing.best_fit_decreasing(lengths)
    assert [o for _, o in placed] == want and len({w for w, _ in placed}) == len(rooms)


def test_packing_on_odd_rows(odd, empty):
    rows = packing.pack(packing.pieces(odd, WORD_BPE)).collect()
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
    assert sum(r.start == 0 for r in rows) == odd.count() and {r.length for r in rows if r.doc_id in (5, 6)} == {1}
    assert packing.pack(packing.pieces(empty, WORD_BPE)).count() == 0


# ---- pipeline ----


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).persist()
        assert after.columns == first.columns, name
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.keys() <= before.keys() and len(kept) > 0.5 * len(before), name
        if name == "n-gram jaccard join":
            classes = brute_join(list(before.items()))
            assert len(kept) == len({c for _, c, _, _ in classes}) and all(n == 0 for _, _, n, _ in brute_join(list(kept.items())))
        if name == "secret scans":
            assert kept.keys() == before.keys() and after.filter("n_chars <> length(text)").isEmpty()
        else:
            assert all(before[i] == t for i, t in kept.items()), name
        docs = after
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), ids)


def test_pipeline_on_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0
