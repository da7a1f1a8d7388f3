"""All corpus queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from riskweave.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
EXPECTED_SQL = {**queries.EXPECTED_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
