"""Runnable queries, one per operator, each next to the SQL it must agree with."""

from importlib import import_module

from cairnbook.plans.registry import ORACLES, QUERIES

_MODULES = ("scalars", "profiles", "listings", "sources", "changes", "logs", "sinks", "ranking", "guarded", "streams")

for _name in _MODULES:
    import_module(f"cairnbook.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
