"""Spans in texts: one scan over the documents, later additions, and the string that lists them.

A span is (start, kind, end): code points, end exclusive, ``kind`` an index into the operator's list of kinds, so that
sorting spans sorts by start and then by kind as listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskweave.llm.batches import by_bytes, no_store

SPAN = "struct<start:long,kind:int,end:long>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

Span = tuple[int, int, int]


def listed(spans: list[Span], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(listed(spans, kinds).encode()).hexdigest()


def as_structs(spans: list[Span]) -> list[dict]:
    return [{"start": s, "kind": k, "end": e} for s, k, e in sorted(spans)]


def span_list(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def by_batch(frame: DataFrame, text: str, schema: str, row: Callable[[str], dict]) -> DataFrame:
    """Every row of ``frame`` with the fields of ``row(text)`` added; ``schema`` types them.  Null texts are empty."""
    fields = T.StructType.fromDDL(schema).fields
    at, names = frame.columns.index(text), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_store()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in by_bytes(batches, at):
            made = [row(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([m[n] for m in made], t) for n, t in zip(names, types, strict=True)]],
                names=[*batch.schema.names, *names],
            )

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *fields]))


def with_added(found: DataFrame, added: DataFrame, kinds: list[str]) -> DataFrame:
    """``found`` (row_id, spans, ...) with the spans of ``added`` (row_id, span) put in, and ``spans`` as a string."""
    extra = added.groupBy("row_id").agg(F.array_distinct(F.collect_list("span")).alias("extra_spans"))
    none = F.array().cast(f"array<{SPAN}>")
    every = F.concat("base_spans", F.coalesce("extra_spans", none))
    return (
        found.join(extra, "row_id", "left")
        .withColumn("spans", span_list(every, kinds))
        .withColumn("n_added", F.coalesce(F.size("extra_spans"), F.lit(0)).cast("long"))
        .drop("extra_spans")
    )
