"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import analysis_queries, consensus_queries, integrity_queries, landscape_queries, relational_queries, source_queries, structure_queries

MODULES = (consensus_queries, landscape_queries, relational_queries, source_queries, analysis_queries, structure_queries, integrity_queries)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE: dict = {name: q for m in MODULES for name, q in m.ORACLE.items()}
