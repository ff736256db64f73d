"""Registered queries over the driver tables, each with its DuckDB counterpart."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import (  # noqa: F401
    q_audit,
    q_evaluation,
    q_metrics,
    q_model,
    q_selection,
    q_sequence,
    q_sources,
    q_streaming,
)
