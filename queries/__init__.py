"""Queries on the given tables, one or more per operator, with SQL for comparison."""

from queries import (  # noqa: F401
    checking,
    discovering,
    flows,
    observing,
    predicates,
    profiles,
    proposing,
    rulegraphs,
    ruletables,
    scoring,
    sources,
)
from queries.base import ORACLES, QUERIES  # noqa: F401
