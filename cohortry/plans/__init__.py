"""Registered queries, grouped by subject."""

from importlib import import_module
from pathlib import Path


def load_all() -> None:
    """Import every ``*_queries`` module, which registers its queries."""
    for path in sorted(Path(__file__).parent.glob("*_queries.py")):
        import_module(f"{__name__}.{path.stem}")
