"""All registered queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from evidence_spark.plans import attempts, concepts, corpus, exchange

_PARTS = (corpus, concepts, attempts, exchange)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
