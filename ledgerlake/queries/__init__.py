"""Queries over the driver's tables, one or more for each operator, and their SQL counterparts."""

from __future__ import annotations

from . import content, events, files, inventory, ledger_snapshots, pages, sketched, snapshot, streams, temporal, versioned  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
