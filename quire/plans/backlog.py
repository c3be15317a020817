"""The registered queries of the document operators and their SQL."""

from quire.plans import cleanup_queries, draft_queries, event_queries, generic_queries, page_queries, relation_queries, text_queries

_MODULES = (text_queries, cleanup_queries, relation_queries, page_queries, event_queries, generic_queries, draft_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
