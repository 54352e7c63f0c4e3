"""Queries on the star-schema tables, each beside the SQL that checks it."""

from tidemark.plans.base import REGISTRY

__all__ = ["REGISTRY", "load_all"]


def load_all() -> dict:
    """Import every plan module so that its queries are registered."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    return REGISTRY


MODULES = (
    "ingest", "prices", "pit", "crosssection", "screens", "fundamentals", "portfolio", "valuation",
    "events", "text", "models", "markets", "streams",
)
