"""Registered queries with the SQL that each must equal."""

from __future__ import annotations

from sportlake.plans import matches, pages, players, quality, quiz, texts
from sportlake.plans.base import as_query, full_sql

MODULES = [matches, players, texts, quality, quiz, pages]

QUERIES = {name: as_query(made) for module in MODULES for name, (made, _) in module.QUERIES.items()}
SQL = {name: full_sql(sql) for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
