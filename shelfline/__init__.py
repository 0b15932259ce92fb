"""Demand and replenishment analytics over SKU x date panels, on Spark."""
