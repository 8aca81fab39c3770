"""Relational building blocks: joins, windows, totals, reshaping."""
