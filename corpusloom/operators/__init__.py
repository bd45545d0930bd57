"""Relational operators: curation, leakage, validation, metrics, selection."""
