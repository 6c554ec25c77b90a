"""Relational operators: search, ranking, ingest, frontier, products, analytics, maintenance."""
