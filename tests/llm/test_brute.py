"""Owned, copied and token-like secrets over a whole table, by brute force."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from riskweave.llm import context_mixing, secrets
from riskweave.llm.tables import table


def candidates(text):
    """(span, value, live) of base and token-like strings, from the plain patterns."""
    assign = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    base = [((m.start(), 0, m.end()), m[1]) for m in re.finditer(assign + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    base += [((m.start(), 1, m.end()), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [((m.start(), 2, m.end()), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    covered = {i for (s, _, e), _ in base for i in range(s, e)}
    more = [((m.start(), 3, m.end()), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and covered.isdisjoint(range(*m.span()))]
    return [(s, v, secrets.looks_live(v)) for s, v in base + [x for x in more if secrets.looks_live(x[1]) and secrets.entropy(x[1]) >= 3.5]]


def judged_plainly(rows):
    """rows (key, source, text) -> key, spans string, owned, copied."""
    found = [(k, source or "", candidates(t or "")) for k, source, t in rows]
    owners = {}
    for _, source, every in found:
        for _, v, _ in every:
            owners.setdefault(v, set()).add(source)
    out = []
    for k, _, every in found:
        copied = [len(owners[v]) >= secrets.MIN_OWNERS for _, v, _ in every]
        owned = [live and not c for (_, _, live), c in zip(every, copied, strict=True)]
        spans = sorted(s for (s, _, _), own in zip(every, owned, strict=True) if s[1] < 3 or own)
        out.append((k, ",".join(f"{secrets.KINDS[x]}:{s}:{e}" for s, x, e in spans), sum(owned), sum(copied)))
    return sorted(out, key=str)


def test_secrets_of_documents_match_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table that holds secrets
    rows = [(r.doc_id, r.source, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = entry.queries()["op3_secret_scan"](spark, sf_dir).select("doc_id", "spans", "n_owned", "n_copied").collect()
    want = judged_plainly(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert any(owned for *_, owned, _ in want)


def test_secrets_of_made_rows_match_brute_force(spark):
    """Values held by one, two and many sources, twice in one text, beside nulls, and a token that touches a base span."""
    keys = [f"Qz{i}x7Lm2Rw9Tb4Vc{i}Yk6Hp" for i in range(4)]
    rows = [(i, f"s{i}", f"see {keys[0]} and {'0f' * 16}") for i in range(5)]
    rows += [(10, "s0", f"{keys[1]} {keys[1]} token={keys[2]}"), (11, "s1", f"{keys[2]}.{keys[3]}"), (12, None, keys[3]), (13, None, None)]
    rows += [(None, "s2", ""), (14, None, f"secret: {keys[1]}+{keys[3]}/AKIA{'Z9' * 8}"), (14, "s9", f"AKIA{'Z9' * 8} your{keys[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = secrets.scan(docs).select("doc_id", "spans", "n_owned", "n_copied").collect()
    assert sorted(map(tuple, got), key=str) == judged_plainly([(k, s, t) for k, s, t in rows])
    assert secrets.scan(docs.limit(0)).count() == 0


def test_many_spans_in_one_text_stay_linear():
    loose = "Zk81mQp0Yt5Wc3RsHb6v"
    text = f"token=abcd1234efgh {loose} " * 20_000
    taken = [s for s, _ in secrets.base_matches(text)]
    found = secrets.token_matches(text, taken)
    assert len(taken) == len(found) == 20_000 and {v for _, v in found} == {loose}


def test_token_numbers_of_any_size_come_back():
    for ids in ([], [0], [5, 2**16, 2**24 - 1], [0, 2**24, 2**24 + 7, 2**32 - 1], list(range(1000))):
        assert context_mixing.unpacked_ids(context_mixing.packed_ids(ids)).tolist() == ids
