"""All named queries of the library with their DuckDB SQL."""

from __future__ import annotations

from .plans import balance, base, contracts, documents, gates, inference, relational, routing, scoring, service, stats, thermo, trials  # noqa: F401


def queries() -> dict[str, base.Plan]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
