"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations


def load():
    """(queries, oracle SQL) of every section."""
    from faultline.catalog import aggregates, cleaning, end_to_end, evaluating, joins, learning, ranges, sorting, storage, streams  # noqa: F401
    from faultline.catalog.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
