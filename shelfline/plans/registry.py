"""Registered queries: name -> (query, oracle SQL or None)."""
from .oracle import build

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, fn, sql=None):
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = build(sql)


def load():
    if not QUERIES:
        from . import catalog
        catalog.register_all()
    return QUERIES, ORACLES
