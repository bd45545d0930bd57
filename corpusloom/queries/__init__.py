"""Registered queries over the data folder, each with its SQL where SQL can say it."""

from __future__ import annotations

from corpusloom.queries import curation, evaluation, features, leakage, small, text

MODULES = [text, curation, leakage, evaluation, features, small]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
