"""The operators run on the given star-schema tables, each with a SQL twin."""

from stocktide.workload import blocks, composites, replenishment


def _parts():
    return [composites.R, replenishment.R, blocks.R]


def queries():
    return {k: fn for part in _parts() for k, fn in part.queries.items()}


def oracle_sql():
    return {k: s for part in _parts() for k, s in part.sql.items()}
