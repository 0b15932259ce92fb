"""Loads every group of registered queries."""
from importlib import import_module

GROUPS = ("tables", "ingest", "series", "quality", "inventory", "suppliers", "skus", "forecast", "policy", "orders")


def register_all():
    for group in GROUPS:
        import_module(f"{__package__}.{group}_queries")
