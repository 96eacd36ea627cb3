"""Registered queries over the driver tables."""

from rankloom.catalog import registry
from rankloom.catalog.registry import ORACLES, QUERIES

_LOADED = False
MODULES = [
    "page_queries", "link_queries", "site_queries", "text_queries", "rank_queries", "source_queries", "audit_queries", "benchmark_queries",
    "stream_queries",
]


def load() -> None:
    """Import the query modules once; each registers its queries."""
    global _LOADED
    if _LOADED:
        return
    import importlib

    for name in MODULES:
        importlib.import_module(f"rankloom.catalog.{name}")
    _LOADED = True


__all__ = ["ORACLES", "QUERIES", "load", "registry"]
