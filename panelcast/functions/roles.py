"""B-01…B-04: find the date, revenue, units and price columns by name.

Metadata only (``df.columns`` / ``df.schema``); no Spark job runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

# Name fragments per role, matched case-insensitively as
# substrings; the first column in table order that contains any fragment wins.
ROLE_PATTERNS = {
    "date": ["date", "time", "month", "period", "week", "day"],
    "revenue": ["revenue", "sales", "income", "amount", "total", "turnover"],
    "units": ["unit", "qty", "quantity", "sold", "volume", "count"],
    "price": ["price", "rate", "cost", "avg_price", "unit_price"],
}


def detect_role(columns: Iterable[str], patterns: Sequence[str]) -> str | None:
    for name in columns:
        low = name.lower()
        if any(p.lower() in low for p in patterns):
            return name
    return None


def resolve_roles(df: DataFrame, overrides: dict[str, str | None] | None = None,
                  exclude: Sequence[str] = ()) -> dict:
    """Map each role to a column name (or None) plus how it was found.

    ``overrides`` pins a role to a column (or to ``None`` for "absent");
    ``exclude`` keeps structural columns (series keys, ``seq``) out of the
    search. Returns ``{role: name, f"{role}_how": "override"|"detected"|
    "fallback"|"missing"}``.
    """
    overrides = overrides or {}
    cols = [c for c in df.columns if c not in set(exclude)]
    out: dict = {}
    for role, pats in ROLE_PATTERNS.items():
        if role in overrides:
            out[role], out[f"{role}_how"] = overrides[role], "override"
            continue
        found = detect_role(cols, pats)
        out[role], out[f"{role}_how"] = found, ("detected" if found else "missing")
    if out["date"] is None and out["date_how"] == "missing" and cols:
        out["date"], out["date_how"] = cols[0], "fallback"          # B-03
    if out["revenue"] is None and out["revenue_how"] == "missing":
        numeric = [f.name for f in df.schema.fields
                   if f.name in cols and isinstance(f.dataType, NumericType)]
        if numeric:                                                   # B-04
            out["revenue"], out["revenue_how"] = numeric[0], "fallback"
    return out
