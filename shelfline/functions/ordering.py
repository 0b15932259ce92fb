"""Order statistics over a whole table without a single-task window.

A global running total is built from range partitions: rows are range
partitioned on the sort key and stamped with their partition number, every
partition is scanned on its own, and only one row per partition (its sum) goes
through an unpartitioned window.  The stamped rows are checkpointed because a
partition number must not change between the two uses.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise


def running_total(df: DataFrame, order, value: Column, out: str) -> DataFrame:
    """Adds `out` = inclusive running sum of `value` in `order`."""
    return running_totals(df, order, {out: value})


def running_totals(df: DataFrame, order, values: dict, by=()) -> DataFrame:
    """Adds inclusive running sums in `order`.  With `by`, columns that `order` starts with, sums restart at each new value of
    them: a value that spans partitions costs one offset row in each."""
    order, by = list(order), list(by)
    # named sums first, so that only plain columns cross the exchange
    df = df.withColumns({f"_v_{name}": v for name, v in values.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stamped = materialise(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    keys = ["_part", *by]
    sums = stamped.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per shuffle partition (and per value of `by` in it)
    offsets = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0).cast("double")).alias(f"_o_{n}")
        for n in values])
    local = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (stamped
            .join(offsets if by else F.broadcast(offsets), same)
            .withColumns({n: F.sum(f"_v_{n}").over(local) + F.col(f"_o_{n}") for n in values})
            .drop("_part", "_p", *[f"_by_{c}" for c in by], *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values]))


def row_numbers(df: DataFrame, order, out: str = "rn", by=()) -> DataFrame:
    """Adds a 1-based position in `order`, global or within each value of the columns `by` that `order` starts with."""
    return (running_totals(df, order, {out: F.lit(1.0)}, by)
            .withColumn(out, F.col(out).cast("long")))


def exact_quantiles(df: DataFrame, value: str, levels: dict, by=()) -> DataFrame:
    """Linearly interpolated quantiles per group: one row per `by`, a column per
    entry of `levels`, and `n`.

    Equal values are counted before the sort, so a value (or a group) holding a
    large share of the rows costs one row, and a large group is spread over as
    many range partitions as it needs.
    """
    by = list(by)
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    placed = running_total(counted, [*by, value], F.col("_n"), "_upto")
    groups = placed.groupBy(*by).agg(
        F.sum("_n").alias("_total"), F.min(F.col("_upto") - F.col("_n")).alias("_base"))
    if by:
        cond = [placed[b].eqNullSafe(groups[b]) for b in by]
        joined = placed.join(groups.select(*[F.col(b).alias(f"_g_{b}") for b in by],
                                           "_total", "_base"),
                             [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by])
    else:
        total, base = groups.select("_total").scalar(), groups.select("_base").scalar()
        joined = placed.withColumns({"_total": total, "_base": base})
    first = F.col("_upto") - F.col("_n") - F.col("_base")
    last = F.col("_upto") - F.col("_base") - 1
    at = lambda pos: F.max(F.when((pos >= first) & (pos <= last), F.col(value)))
    aggs = [F.max("_total").cast("long").alias("n")]
    for i, q in enumerate(levels.values()):
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    agged = joined.groupBy(*by).agg(*aggs)
    return agged.select(*by, "n", *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
        for i, name in enumerate(levels)])
