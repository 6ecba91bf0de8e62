"""Queries over the given tables, one module per group of rules."""

from importlib import import_module

from runledger.catalog.base import REGISTRY, Tables

for _module in ("scalars", "schema", "slices", "joins", "ledger", "graph", "documents", "live"):
    import_module(f"runledger.catalog.{_module}")

__all__ = ["REGISTRY", "Tables"]
