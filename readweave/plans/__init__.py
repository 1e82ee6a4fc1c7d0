"""Registered queries over the shared tables, one module for each group of operators."""

from importlib import import_module

MODULES: tuple[str, ...] = ("structure", "clusters", "quality", "counts", "sequences", "tables", "leftovers", "segments")


def load() -> None:
    """Import every module of queries, so that the registry is filled."""
    for name in MODULES:
        import_module(f"readweave.plans.{name}")
