"""All core queries by name, with their SQL statements."""

from __future__ import annotations

from docketry.plans import analytics, benchmark, connectors, evidence, indexes, matters, observations, pages, profiles, quantities, recurrence, visits  # noqa: F401 - importing registers
from docketry.plans.registry import QUERIES, SQL, Query


def flagship(spark, sf_dir: str):
    """Largest money amounts with their provenance."""
    return QUERIES["amounts_range"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES) | {"p2_found": quantities.p2_found, "p2_unit_shifts": quantities.p2_unit_shifts, "p2_own_values": quantities.p2_own_values}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
