"""Registered queries."""

from importlib import import_module

MODULES = [
    "flagship", "cleaning", "segments", "statistics", "counting", "curation", "scoring", "stances", "topics",
]


def load() -> None:
    for name in MODULES:
        import_module(f"rostrum.catalog.{name}")
