"""All registered queries of the evidence operators."""

from __future__ import annotations

from . import claims, constraints, corpus, retrieval, store, textunits

FLAGSHIP = "bm25_topk"
_MODULES = (retrieval, store, textunits, claims, constraints, corpus)
QUERIES = {name: query for m in _MODULES for name, query in m.plans.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.plans.oracles.items()}
