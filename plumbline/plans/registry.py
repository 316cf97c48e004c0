"""All queries of the library by name, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from plumbline.plans import evaluation, intake, retrieval, service

FLAGSHIP = "bm25_top10"

_ALL = retrieval.QUERIES | evaluation.QUERIES | intake.QUERIES | service.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
