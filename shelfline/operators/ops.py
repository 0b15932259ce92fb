"""Operational tables: latency summary, recent samples, spend ledger."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordering import running_totals


def latency_summary(events: DataFrame) -> DataFrame:
    """Count, two order statistics and mean per operation.

    sorted[floor(n/2)] and sorted[floor(.95 n)] are read off counted values, so a busy
    operation is reduced before it is sorted."""
    counted = events.groupBy("operation", "value").agg(F.count(F.lit(1)).cast("double").alias("k"))
    placed = running_totals(counted, [F.asc("operation"), F.asc("value")], {"upto": F.col("k")})
    g = placed.groupBy("operation").agg(F.sum("k").alias("n"), F.min(F.col("upto") - F.col("k")).alias("base"),
                                        (F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("mean"))
    j = placed.join(g, "operation")
    at = lambda pos: F.min(F.when(F.col("upto") - F.col("base") > pos, F.col("value")))
    return j.groupBy("operation").agg(
        F.max("n").cast("long").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"),
        at(F.floor(F.col("n") * 0.95)).alias("p95"), F.max("mean").alias("mean"))


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """Latest samples kept: a top-k by time."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def spend_ledger(events: DataFrame, budget: float) -> DataFrame:
    """Entries with the day's spend before them and whether the budget refused them.

    The running total restarts per day but is built over range partitions, so a day
    with most of the entries is spread over many tasks."""
    e = events.where(F.col("value") > 0).withColumn("day", F.to_date("ts"))
    order = [F.asc("day"), F.asc("ts"), F.asc("event_id")]
    j = running_totals(e, order, {"_upto": F.col("value")}, by=["day"])
    before = F.col("_upto") - F.col("value")
    return j.select("event_id", "day", "operation", "value", before.alias("spent_before"),
                    (F.round(before, 6) >= budget).alias("refused"))


def spend_by_context(events: DataFrame) -> DataFrame:
    """Daily spend by context with day totals."""
    e = events.where(F.col("value") > 0).withColumn("day", F.to_date("ts"))
    return e.rollup("day", "operation").agg(F.sum("value").alias("usd"), F.count(F.lit(1)).alias("n")).where(
        F.col("day").isNotNull())
