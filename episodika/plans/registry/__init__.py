"""All registered queries."""

from importlib import import_module

from episodika.plans.registry.base import ORACLES, QUERIES

MODULES = ["retrieval", "finding", "ingest", "storage", "texts", "reading", "linkage", "wiki", "normalise", "evaluation"]

for _module in MODULES:
    import_module(f"episodika.plans.registry.{_module}")

__all__ = ["ORACLES", "QUERIES"]
