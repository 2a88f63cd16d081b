"""Every query of the reference's own operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from halyard.plans import library_ops, retrieval, streams, text_ops

MODULES = (retrieval, library_ops, text_ops, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
