"""Small-table helpers."""
from pyspark.sql import DataFrame, functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row tables with distinct column names, put next to each other."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
