"""Every registered query of the library with its DuckDB SQL."""

from __future__ import annotations

from .plans import command_queries, history_queries, ledger_queries, other_queries, payload_queries, screen_queries, source_queries, stream_queries, text_queries, walk_queries  # noqa: F401  (they register their queries)
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "decision_queue"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
