"""Secret scans with corpus-wide ownership frequency.

One pass finds the base patterns and wider token-like strings in every whole text and keeps a hash of each value.  The
hashes are counted over the whole corpus by distinct repositories and owners.  A value that many owners have is a copied
example; one that few owners have and that looks live (mixed, of high entropy, no placeholder) is a credential.  Spans of
the base patterns always stay; token-like strings are added where they are owner-specific.  Values never leave the scan,
only their hashes.

Edge rules: null and empty texts have no spans and stay as rows; texts of any length are scanned whole; null repositories
and owners count together as one unknown owner; repeated rows are rows of their own, and a value that a text holds twice is
two candidates; spans with equal starts are listed by kind; an empty table gives an empty result; columns beyond the named
ones may have any name, as only the named ones are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.spans import SPAN, Span, as_structs, by_batch, digest, with_added
from riskweave.llm.tables import fresh_name
from riskweave.sources.scratch import staged

KINDS = ["assign", "access", "hex", "token"]
MIN_OWNERS = 3  # a value that so many distinct owners or repositories have is a copied example

ASSIGN = re.compile(
    r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|your|xxxx|0{8}|1234567", re.IGNORECASE)


def base_matches(text: str) -> list[tuple[Span, str]]:
    """Spans of the base patterns with the secret value each holds."""
    found = [((m.start(), 0, m.end()), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [((m.start(), 1, m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [((m.start(), 2, m.end()), m[0]) for m in HEX.finditer(text)]


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_live(value: str) -> bool:
    """Letters and digits mixed, varied enough, and no placeholder."""
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return mixed and entropy(value) >= 2.5 and not PLACEHOLDER.search(value)


def token_matches(text: str, taken: list[Span]) -> list[tuple[Span, str]]:
    """Token-like strings outside the base spans that look live."""
    starts, ends, found = [], [], []
    for s, _, e in sorted(taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in TOKEN.finditer(text):
        i = bisect_right(ends, m.start())  # the first span that ends beyond the start of the string
        apart = i == len(ends) or m.end() <= starts[i]
        if apart and looks_live(m[0]) and entropy(m[0]) >= 3.5:
            found.append(((m.start(), 3, m.end()), m[0]))
    return found


def value_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def scan_text(text: str) -> dict:
    base = base_matches(text)
    spans = [s for s, _ in base]
    every = base + token_matches(text, spans)
    kinds = Counter(k for _, k, _ in spans)
    return {
        "n_assign": kinds[0],
        "n_access": kinds[1],
        "n_hex": kinds[2],
        "base_sha256": digest(spans, KINDS),
        "base_spans": as_structs(spans),
        "candidates": [
            {"span": {"start": s, "kind": k, "end": e}, "value": value_hash(v), "live": looks_live(v)}
            for (s, k, e), v in every
        ],
    }


SCANNED = (
    f"n_assign long, n_access long, n_hex long, base_sha256 string, base_spans array<{SPAN}>, "
    f"candidates array<struct<span:{SPAN},value:string,live:boolean>>"
)


def ownership(candidates: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """For each value hash: distinct repositories and owners, and whether the value is a copied example."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (
        candidates.groupBy("value", unknown("repository").alias("repository"), unknown("owner").alias("owner"))
        .agg(F.lit(1))
        .groupBy("value")
        .agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
        .withColumn("copied", F.greatest("repositories", "owners") >= min_owners)
    )


def judged(scanned: DataFrame) -> DataFrame:
    """One row per candidate: row_id, span, live, repositories, owners, copied."""
    each = scanned.filter(F.size("candidates") > 0).select("row_id", "repository", "owner", F.explode("candidates").alias("c"))
    each = each.select("row_id", "repository", "owner", "c.*")
    return each.join(ownership(each), "value")


def scanned_rows(docs: DataFrame, repository: str, owner: str, text: str, keep: list[str]) -> DataFrame:
    rows = docs.select(
        *keep, F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.col(text).alias("scanned_text")
    )
    found = by_batch(rows, "scanned_text", SCANNED, scan_text).drop("scanned_text")
    return staged(found.withColumn("row_id", F.monotonically_increasing_id()), "secrets")


def scan(docs: DataFrame, key: str = "doc_id", repository: str = "source", owner: str = "source", text: str = "text") -> DataFrame:
    """Per row: the key, counts and digest of base spans, all spans, and how many candidates are copied or owned."""
    found = scanned_rows(docs, repository, owner, text, [key])
    verdicts = judged(found)
    owned = F.col("live") & ~F.col("copied")
    counts = verdicts.groupBy("row_id").agg(
        F.sum(owned.cast("long")).alias("n_owned"), F.sum(F.col("copied").cast("long")).alias("n_copied")
    )
    added = verdicts.filter(owned & (F.col("span.kind") == 3)).select("row_id", "span")
    rows = with_added(found, added, KINDS).join(counts, "row_id", "left")
    return rows.select(
        key, "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def redacted(docs: DataFrame, repository: str = "source", owner: str = "source", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns, with owner-specific live-looking values replaced by ``mark``; examples stay.

    Rows that hold no candidate pass by without a shuffle.
    """
    columns = docs.columns
    row, hits = fresh_name(docs, "row_id"), fresh_name(docs, "candidates")
    tagged = by_batch(
        docs, text, f"{hits} array<struct<span:{SPAN},value:string,live:boolean>>",
        lambda t: {hits: scan_text(t)["candidates"]},
    )
    tagged = staged(tagged.withColumn(row, F.monotonically_increasing_id()), "secrets-redact")
    some = tagged.filter(F.size(hits) > 0)
    verdicts = judged(
        some.select(
            F.col(row).alias("row_id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"),
            F.col(hits).alias("candidates"),
        )
    )
    cuts = (
        verdicts.filter(F.col("live") & ~F.col("copied"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.col("span"))).alias("cuts"))
        .select(F.col("row_id").alias(row), F.col("cuts").alias(hits + "_cuts"))
    )
    # pieces between the spans: overlapping spans are merged by taking the furthest end so far
    body, spans = F.col(text), F.col(hits + "_cuts")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        F.struct(
            F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"),
            x["end"].alias("at"),
        ),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at")))
    rest = lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.length(body)))
    rewritten = F.when(spans.isNotNull(), F.aggregate(spans, start, step, rest)).otherwise(body)
    mended = some.join(cuts, row, "left").withColumn(text, rewritten).select(*columns)
    return tagged.filter(F.size(hits) == 0).select(*columns).unionByName(mended)
