"""The queries of the library by name, and the SQL that gives the same rows."""

from . import documents, ledger, reports, retrieval

_PARTS = (retrieval, documents, ledger, reports)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
