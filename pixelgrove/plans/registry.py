"""Every registered query of the image operators, with the SQL that another engine checks it by."""

from __future__ import annotations

from . import animations, batch, headers, memory, notes, pixels, requests, rules, sizes

_MODULES = (sizes, rules, requests, notes, batch, pixels, animations, headers, memory)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
