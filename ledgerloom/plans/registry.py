"""Every registered query of the library and its SQL oracle."""

from __future__ import annotations


def _modules():
    from . import flows, invoices, pages

    return [invoices, pages, flows]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
