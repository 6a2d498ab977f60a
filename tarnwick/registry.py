"""Named queries of the retrieval engine and their SQL oracles."""

from __future__ import annotations

from tarnwick.plans import queries as Q


def queries():
    return dict(Q.QUERIES)


def oracle_sql():
    return dict(Q.ORACLE)
