"""Operators of a training-data pipeline: one module each, registered in queries.py."""
