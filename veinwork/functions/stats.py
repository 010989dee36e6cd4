"""Evidence statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The z of 95 % and the gate's thresholds.
Z = 1.96
AUTO_FLOOR, AUTO_EXCEPTIONS, AUTO_ROLE = 0.9, 3, 0.8
SUGGEST_OBSERVED, SUGGEST_ROLE = 0.8, 0.5


def wilson(hits: Column, n: Column) -> Column:
    """Lower bound of the Wilson interval; 0 for an empty population."""
    n = F.when(n > 0, n.cast("double"))
    p = hits / n
    centre = p + Z * Z / (2 * n)
    spread = Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    return F.coalesce((centre - spread) / (1 + Z * Z / n), F.lit(0.0))


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def gate(n: Column, v: Column, role: Column, applicable: Column | None = None) -> dict[str, Column]:
    """floor, observed (published to four places) and status, which compares exact values."""
    applicable = F.lit(True) if applicable is None else applicable
    floor = wilson(n - v, n)
    observed = F.when(n > 0, (n - v) / F.when(n > 0, n)).otherwise(F.lit(0.0))
    status = (
        F.when(applicable & (floor >= AUTO_FLOOR) & (v <= AUTO_EXCEPTIONS) & (role >= AUTO_ROLE), "AUTO")
        .when(applicable & (observed >= SUGGEST_OBSERVED) & (role >= SUGGEST_ROLE), "SUGGEST")
        .otherwise("REJECT")
    )
    return {"floor": round4(floor), "observed": round4(observed), "status": status}


def wilson_sql(hits: str, n: str) -> str:
    p = f"(({hits}) / nullif(({n})::DOUBLE, 0))"
    d = f"({n})::DOUBLE"
    return f"coalesce(({p} + {Z * Z!r} / (2 * {d}) - {Z} * sqrt(({p} * (1 - {p}) + {Z * Z!r} / (4 * {d})) / {d})) / (1 + {Z * Z!r} / {d}), 0.0)"


def gate_sql(n: str, v: str, role: str, applicable: str = "true") -> str:
    """The gate's three columns in SQL."""
    floor = f"(CASE WHEN ({n}) > 0 THEN {wilson_sql(f'(({n}) - ({v}))', n)} ELSE 0.0 END)"
    observed = f"(CASE WHEN ({n}) > 0 THEN (({n}) - ({v})) / ({n})::DOUBLE ELSE 0.0 END)"
    return (
        f"floor({floor} * 10000 + 0.5) / 10000 AS floor, floor({observed} * 10000 + 0.5) / 10000 AS observed, "
        f"CASE WHEN {applicable} AND {floor} >= {AUTO_FLOOR} AND ({v}) <= {AUTO_EXCEPTIONS} AND ({role}) >= {AUTO_ROLE} THEN 'AUTO' "
        f"WHEN {applicable} AND {observed} >= {SUGGEST_OBSERVED} AND ({role}) >= {SUGGEST_ROLE} THEN 'SUGGEST' ELSE 'REJECT' END AS status"
    )
