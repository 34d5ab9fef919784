"""Queries over the test tables, one module per group of operators."""

from batchwright.plans import aggregates, appends, duplicates, generated, reads, rows, streams  # noqa: F401
from batchwright.plans.registry import ORACLES, QUERIES  # noqa: F401
