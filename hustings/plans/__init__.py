"""Registered queries over the driver tables and their SQL counterparts."""

from importlib import import_module


def load() -> None:
    """Import the modules that register queries."""
    for name in ("rollcall", "candidates", "people", "texts", "merges"):
        import_module(f"hustings.plans.{name}")
