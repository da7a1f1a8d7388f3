"""Personal data with information-theoretic sanitisation.

Base patterns (email, ip, card, phone) are found in every whole text.  Their values are the protected entities.  A term, a
run of letters and digits of any length, discloses an entity as far as seeing the term makes the entity likelier: pointwise
mutual information over the documents, pmi(c; t) = log(N * n(c, t) / (n(c) * n(t))), against what there is to disclose,
ic(c) = log(N / n(c)).  The ratio is 1 where the term occurs only in documents with the entity.  A term whose ratio reaches
``THRESHOLD`` for some entity is sanitised at every occurrence in every document: kind ``term``.

An entity of one document has n(c, t) = n(c) = 1, so the document frequency n(t) alone decides.  For an entity of several
documents the term must share ``SUPPORT`` of them; one shared document of many would be chance for any rare word.

Edge rules: words that overlap an entity are no terms; an entity that every document holds has nothing left to disclose;
null and empty texts have no spans and stay as rows; texts of any length are scanned whole; repeated rows are rows of their
own and count as documents of their own; columns beyond the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.spans import SPAN, Span, as_structs, by_batch, digest, with_added
from riskweave.sources.scratch import staged

KINDS = ["email", "ip", "card", "phone", "term"]
TERM = 4
THRESHOLD = 0.8
SUPPORT = 2
FLUSH = 500_000  # distinct terms or pairs that a task counts before it hands them on
LONG = 64  # longer terms are counted by their hash
FREQUENT = 10_000  # most frequent terms, too frequent to disclose anything, that tasks leave out beforehand
BITS = 26  # of the table that tells tasks which values may matter; a join settles its errors

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
# the lookbehind and possessive counts keep long runs of digits linear and match what the plain pattern matches
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain``, found from each @ so that long runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return found


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small_part, m.groups()))]
        for m in CARD.finditer(text):
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def entity_hash(kind: int, value: str) -> str:
    plain = value.lower() if kind == 0 else value if kind == 1 else digits_of(value)
    return hashlib.sha256(f"{kind}:{plain}".encode()).hexdigest()[:32]


def entities_of(text: str, spans: list[Span]) -> set[str]:
    return {entity_hash(k, text[s:e]) for s, k, e in spans}


def term_of(word: str) -> str:
    term = word.lower()
    return term if len(term) <= LONG else hashlib.sha256(term.encode()).hexdigest()


def words_outside(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The words that overlap no span."""
    merged: list[list[int]] = []
    for s, _, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    ends = [e for _, e in merged]
    for m in WORD.finditer(text):
        i = bisect_left(ends, m.start() + 1)  # the first span that ends after the start of the word
        if i == len(ends) or m.end() <= merged[i][0]:
            yield m


def terms_of(text: str, spans: list[Span]) -> set[str]:
    words = {m[0] for m in words_outside(text, spans)} if spans else set(WORD.findall(text))
    return {term_of(w) for w in words}


# ---- which values may matter ----------------------------------------------------------------------------------------


def marked(values: DataFrame) -> bytearray:
    """A bit for the hash of each of ``values`` (value), 2 ** BITS at any number of values."""
    at = F.crc32("value").bitwiseAND(F.lit((1 << BITS) - 1)) + 1  # bucket numbers start at 1
    parts = values.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("body"))
    table = bytearray(1 << BITS - 3)
    for row in parts.collect():  # as many as the constant says
        start = (row["bucket"] - 1) * len(row["body"])
        table[start : start + len(row["body"])] = row["body"]
    return table


def may_hold(table: bytearray, value: str) -> int:
    at = zlib.crc32(value.encode()) & ((1 << BITS) - 1)
    return table[at >> 3] >> (at & 7) & 1


# ---- counts over all documents --------------------------------------------------------------------------------------


def added_up(docs: DataFrame, text: str, names: tuple[str, str], keys: Callable[[str], Iterator[tuple[str, str]]]) -> DataFrame:
    """For every key the number of documents that have it; each task adds up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def emit() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k in keys(t or ""):
                    counts[k] += 1
                    if len(counts) >= FLUSH:
                        yield emit()
                        counts.clear()
        yield emit()

    return docs.select(text).mapInArrow(run, f"{names[0]} string, {names[1]} string, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def counts_of(docs: DataFrame, text: str) -> DataFrame:
    """(kind, value, n): documents of every ``term`` and ``entity``, and ``all`` documents; written once."""

    def keys(t: str) -> Iterator[tuple[str, str]]:
        yield "all", ""
        spans = base_spans(t)
        for e in entities_of(t, spans):
            yield "entity", e
        for w in terms_of(t, spans):
            yield "term", w

    return staged(added_up(docs, text, ("kind", "value"), keys), "privacy-counts")


def disclosing(docs: DataFrame, text: str, threshold: float, support: int) -> tuple[DataFrame, set[str]]:
    """The terms (value) whose disclosure reaches ``threshold`` for some entity, and frequent terms that reach it for none."""
    counts = counts_of(docs, text)
    n_docs = sum(r["n"] for r in counts.filter("kind = 'all'").collect())  # one row
    entities = counts.filter(f"kind = 'entity' AND n < {n_docs}").select(F.col("value").alias("entity"), F.col("n").alias("n_entity"))
    terms = counts.filter("kind = 'term'").select(F.col("value").alias("term"), F.col("n").alias("n_term"))
    # n(c, t) <= n(c), so a disclosing term has n(t) <= N * (n(c) / N) ** threshold
    most = n_docs * ((entities.agg(F.max("n_entity")).first()[0] or 0) / max(n_docs, 1)) ** threshold * (1 + 1e-9)
    often = terms.filter(F.col("n_term") > most).orderBy(F.desc("n_term"), "term").limit(FREQUENT)
    frequent = {r["term"] for r in often.collect()}
    several = marked(entities.filter("n_entity > 1").select(F.col("entity").alias("value")))
    shared = docs.sparkSession.sparkContext.broadcast((frequent, several))

    def keys(t: str) -> Iterator[tuple[str, str]]:
        spans = base_spans(t)
        if not spans:
            return
        frequent, several = shared.value
        found = entities_of(t, spans)
        paired = [e for e in found if may_hold(several, e)]
        if len(paired) < len(found):  # entities of one document are alike
            paired.append("")
        near = terms_of(t, spans) - frequent
        for e in paired:
            for w in near:
                yield e, w

    # entities of one document need no count of theirs; their pairs are spread by the term, so that no join key holds them all
    single = F.col("entity") == ""
    pairs = added_up(docs, text, ("entity", "term"), keys).withColumn("single", single)
    pairs = pairs.withColumn("entity", F.when(single, F.concat(F.lit("-"), "term")).otherwise(F.col("entity")))
    n = F.lit(float(max(n_docs, 1)))
    pmi = F.log(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    found = (
        pairs.join(entities, "entity", "left")
        .withColumn("n_both", F.when(F.col("single"), 1).otherwise(F.col("n")))
        .withColumn("n_entity", F.when(F.col("single") & F.lit(n_docs > 1), 1).otherwise(F.col("n_entity")))
        .filter(F.col("n_both") >= F.least(F.lit(support), "n_entity"))
        .filter(F.col("n_entity").isNotNull())
        .join(terms, "term")
        .filter(pmi >= threshold * F.log(n / F.col("n_entity")))
    )
    return staged(found.select(F.col("term").alias("value")).distinct(), "privacy-terms"), frequent


# ---- the texts ------------------------------------------------------------------------------------------------------


SCANNED = (
    f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans array<{SPAN}>, "
    f"candidates array<struct<term:string,spans:array<{SPAN}>>>"
)


def scanned(docs: DataFrame, keep: Column, text: str, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``keep``, base counts and spans and a row_id, and the disclosing terms (row_id, span) in them."""
    terms, frequent = disclosing(docs, text, threshold, support)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, marked(terms)))

    def scan_text(t: str) -> dict:
        spans, (frequent, table) = base_spans(t), shared.value
        kinds = Counter(k for _, k, _ in spans)
        named = {w: term_of(w) for w in set(WORD.findall(t))}
        named = {w: v for w, v in named.items() if v not in frequent and may_hold(table, v)}
        places: dict[str, list[Span]] = {}
        if named:
            for m in words_outside(t, spans):
                if m[0] in named:
                    places.setdefault(named[m[0]], []).append((m.start(), TERM, m.end()))
        return {
            "n_email": kinds[0],
            "n_ip": kinds[1],
            "n_card": kinds[2],
            "n_phone": kinds[3],
            "base_sha256": digest(spans, KINDS),
            "base_spans": as_structs(spans),
            "candidates": [{"term": v, "spans": as_structs(at)} for v, at in places.items()],
        }

    rows = docs.select(keep.alias("kept"), F.col(text).alias("scanned_text"))
    found = by_batch(rows, "scanned_text", SCANNED, scan_text).drop("scanned_text")
    found = staged(found.withColumn("row_id", F.monotonically_increasing_id()), "privacy")
    each = found.select("row_id", F.explode("candidates").alias("c")).select("row_id", F.col("c.term").alias("value"), "c.spans")
    added = each.join(terms, "value", "left_semi").select("row_id", F.explode("spans").alias("span"))
    return found.drop("candidates"), added


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT
) -> DataFrame:
    """Per row: the key, counts and digest of base spans, and all spans, disclosing terms included.

    ``spans`` lists those of rows that hold an entity, ``elsewhere`` the disclosing terms of rows that hold none.
    """
    found, added = scanned(docs, F.col(key), text, threshold, support)
    own, every = F.size("base_spans") > 0, F.col("spans")
    return with_added(found, added, KINDS).select(
        F.col("kept").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(own, every).otherwise("").alias("spans"), F.col("n_added").alias("n_term"), F.when(own, "").otherwise(every).alias("elsewhere"),
    )


def sanitise(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The same rows and columns, with every entity and every disclosing term replaced by its kind."""
    found, added = scanned(docs, F.struct(*docs.columns), text, threshold, support)
    extra = added.groupBy("row_id").agg(F.collect_list("span").alias("extra_spans"))
    none = F.array().cast(f"array<{SPAN}>")
    rows = found.join(extra, "row_id", "left").select("kept", F.concat("base_spans", F.coalesce("extra_spans", none)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = dict(zip(docs_columns, batch.column(0).flatten(), strict=True))
            lists, old = batch.column(1).to_pylist(), kept[text]
            new = [t and sanitised(t, [(x["start"], KINDS[x["kind"]], x["end"]) for x in s]) for t, s in zip(old.to_pylist(), lists, strict=True)]
            kept[text] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=docs_columns)

    docs_columns = docs.columns
    return rows.mapInArrow(run, docs.schema)


def sanitised(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind, which is as far as an entity or term is generalised."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
