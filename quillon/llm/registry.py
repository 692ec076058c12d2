"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import queries_native, queries_python

QUERIES = {**queries_native.QUERIES, **queries_python.QUERIES}
ORACLES = {**queries_native.ORACLES, **queries_python.ORACLES}
