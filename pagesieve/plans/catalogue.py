"""All core queries and their SQL."""

from __future__ import annotations

from pagesieve.plans import audit_queries, curation_queries, document_queries, html_queries, model_queries, nested, page_queries, record_queries, roundtrip_queries, schema_queries, url_queries

_MODULES = (nested, url_queries, html_queries, audit_queries, curation_queries, page_queries, model_queries, document_queries, record_queries, schema_queries, roundtrip_queries)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
FLAGSHIP = "url_lexical"
