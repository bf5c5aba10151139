"""Named queries over the test tables, each with an independent SQL text where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

from stackmill.catalog.registry import ENTRIES, Entry

MODULES = (
    "metrics_queries", "split_queries", "clean_queries", "feature_queries", "ledger_queries", "source_queries", "model_queries",
)


def load() -> dict[str, Entry]:
    """Import all query modules and return the registry."""
    for name in MODULES:
        import_module(f"stackmill.catalog.{name}")
    return ENTRIES


def list_operators() -> dict[str, str]:
    """Every query name with its description."""
    return {name: e.about for name, e in load().items()}
