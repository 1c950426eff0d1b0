"""All queries of the relational engine by name, each with its SQL counterpart."""

from __future__ import annotations

from siskin.plans import aggregates, catalogue, changes, expressions, grouping, joins, leaderboard, ordering, scans, sketched, streams, subqueries, windows  # noqa: F401


def queries():
    return dict(catalogue.QUERIES)


def oracle_sql():
    return dict(catalogue.ORACLE)
