"""Registered queries, one module per family."""

from tidemark.plans import aggregation, audit, checks, frames, joining, learning, rows, runs, storage, streams, usage, versions, windowing  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
