"""All registered queries of the engine."""

from __future__ import annotations

from quern.plans import queries_answers, queries_asking, queries_communities, queries_concepts, queries_entities, queries_graph, queries_layout, queries_more, queries_ner, queries_paths, queries_retrieval, queries_searches, queries_segments, queries_text  # noqa: F401  (they register)
from quern.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Lexical and vector search over all documents, fused by reciprocal rank."""
    return QUERIES["hybrid_rrf"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
