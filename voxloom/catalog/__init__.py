"""The registered queries and the SQL each one is checked against."""

from voxloom.catalog import (
    experiments,
    invariants,
    learning,
    relational,
    requirements,
    sources,
    texts,
)

MODULES = [sources, relational, experiments, texts, requirements, learning, invariants]


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
