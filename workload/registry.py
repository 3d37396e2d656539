"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from workload import analytics, documents, files, text_logs

flagship = analytics.top_customers
PARTS = (analytics, documents, text_logs, files)
QUERIES = {name: fn for part in PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
