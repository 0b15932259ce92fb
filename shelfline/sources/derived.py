"""Panels, suppliers, receipts, order lines and purchase orders derived from the
star-schema test tables, so that every operator runs over the given data."""
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

WEEK, MONTH = "week", "month"
# fixed value: panel rows one task makes
TASK_ROWS = 500_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hash8(col):
    """First 32 bits of the md5 of a string, as a long."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def _brand_type():
    return F.upper(F.concat(F.col("p_brand"), F.lit("|"), F.col("p_type")))


def _skus(part: DataFrame, grain: str) -> DataFrame:
    if grain == "part":
        return part.select(
            "p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku_id"),
            F.col("p_type").alias("category"), "p_retailprice")
    return part.select("p_partkey", _brand_type().alias("sku_id"),
                       F.col("p_type").alias("category"), "p_retailprice")


def cells(spark, sf, grain="brand_type", period=WEEK) -> DataFrame:
    """Sales per SKU and period: partial sums before the only wide exchange."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    skus = _skus(table(spark, sf, "part"), grain).select("p_partkey", "sku_id")
    return (lines.join(skus, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("sku_id", F.to_date(F.date_trunc(period, "l_shipdate")).alias("date"))
            .agg(F.sum("l_quantity").alias("demand"),
                 F.sum("l_extendedprice").alias("_ext")))


def dense_rows(spark, sf, grain="brand_type", period=WEEK) -> int:
    """About the rows of the dense panel: SKUs times periods.  Only its partitions go by this number."""
    skus = _skus(table(spark, sf, "part"), grain).agg(F.approx_count_distinct("sku_id")).first()[0]
    lo, hi = table(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return skus * ((hi - lo).days // (7 if period == WEEK else 28) + 1) if lo else 0


def fill_gaps(cell: DataFrame, period=WEEK, bounds=None, rows: int = 0) -> DataFrame:
    """Dense SKU x period grid over the calendar of the whole table.

    Each row emits itself and the empty periods up to the next row of its SKU
    (the first row also those before it), so one exchange by SKU is enough and
    whatever follows per SKU reuses it.  The exchange carries the sparse rows, whose
    size says nothing of the grid made from them: where the grid has more than
    `TASK_ROWS` of its about `rows` rows a core, its partitions are given by `rows`.
    """
    calendar = bounds if bounds is not None else cell
    spark, parts = cell.sparkSession, -(-rows // TASK_ROWS)
    if parts > spark.sparkContext.defaultParallelism:
        # not fewer than other exchanges have, or a join would move the grid again
        cell = cell.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sku_id")
    step = "interval 7 days" if period == WEEK else "interval 1 month"
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    by_date = W.partitionBy("sku_id").orderBy("date")
    spaced = (cell
              .withColumn("_next", F.lead("date").over(by_date))
              .withColumn("_first", F.row_number().over(by_date) == 1)
              .withColumns({"_lo": lo, "_hi": hi})
              .withColumn("_from", F.when(F.col("_first"), F.col("_lo")).otherwise(F.col("date")))
              .withColumn("_to", F.when(F.col("_next").isNotNull(), F.date_sub("_next", 1))
                          .otherwise(F.col("_hi"))))
    grid = spaced.withColumn("_day", F.explode(F.expr(f"sequence(_from, _to, {step})")))
    own = F.col("_day") == F.col("date")
    measures = [c for c in cell.columns if c not in ("sku_id", "date")]
    return grid.select(
        "sku_id", F.col("_day").alias("date"), F.col("_hi").alias("_last"),
        *[F.when(own, F.col(m)).alias(m) for m in measures])


def panel(spark, sf, grain="brand_type", period=WEEK) -> DataFrame:
    """Canonical nine-column panel."""
    dense = fill_gaps(cells(spark, sf, grain, period), period, rows=dense_rows(spark, sf, grain, period))
    attrs = (_skus(table(spark, sf, "part"), grain).groupBy("sku_id")
             .agg(F.min("category").alias("category"),
                  (F.round(F.sum("p_retailprice"), 1) * 0.6 / F.count(F.lit(1))).alias("unit_cost"))
             .withColumn("_key", F.pmod(hash8(F.col("sku_id")), F.lit(10))))
    sup = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("_key"), F.col("s_name").alias("supplier"))
    attrs = attrs.join(sup, "_key", "left")
    per_sku = W.partitionBy("sku_id")
    demand = F.coalesce(F.col("demand"), F.lit(0.0))
    full = dense.join(attrs, "sku_id")
    return full.select(
        "sku_id", "date", demand.alias("demand"),
        F.when(F.col("date") == F.col("_last"),
               F.round(F.avg(demand).over(per_sku)
                       * (1 + F.pmod(hash8(F.concat(F.lit("oh"), F.col("sku_id"))), F.lit(8))), 2)
               ).alias("on_hand"),
        (F.lit(3.0) + F.pmod(F.col("_key") * 7, F.lit(25)) + F.dayofmonth("date") % 3
         ).cast("double").alias("lead_time_days"),
        "unit_cost",
        (F.round("_ext", 2) / F.col("demand")).alias("unit_price"),
        "supplier", "category")


def panel_bt(spark, sf):
    return panel(spark, sf)


def panel_pm(spark, sf):
    return panel(spark, sf, grain="part", period=MONTH)


def panel_pw(spark, sf):
    return panel(spark, sf, grain="part", period=WEEK)


def _supplier_key(key):
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 5, "0"))


def suppliers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v) for v in values]),
                                          (k % m + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        _supplier_key(k).alias("supplier_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("orders@s"), k.cast("string"), F.lit(".example.com")).alias("contact_email"),
        pick(["USA", "Canada", "Mexico", "China", "Vietnam"], 5).alias("country"),
        pick(["Net 30", "Net 45", "2/10 Net 60", "prepaid", "15 days"], 5).alias("payment_terms"),
        (F.lit(3.0) + (k * 7) % 25).cast("double").alias("default_lead_time_days"),
        (F.lit(1.0) + k % 4).cast("double").alias("lead_time_std_days"),
        pick([12.0, 24.0, 50.0, 100.0], 4).alias("moq"),
        pick([1.0, 6.0, 12.0, 24.0, 48.0], 5).alias("case_pack"),
        F.lit("").alias("notes"))


def receipts(spark, sf) -> DataFrame:
    skus = _skus(table(spark, sf, "part"), "brand_type").select("p_partkey", "sku_id")
    k = F.col("l_suppkey")
    lead = (F.lit(3) + (k * 7) % 25).cast("int")
    jitter = ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7) % 9 - 3).cast("int")
    received = F.to_date("l_shipdate")
    ordered = F.date_sub(received, lead + jitter)
    return (table(spark, sf, "lineitem").join(skus, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat_ws("-", *[F.col(c).cast("string") for c in
                                   ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                            received.cast("string")).alias("receipt_id"),
                "sku_id", _supplier_key(k).alias("supplier_id"),
                ordered.alias("ordered_date"),
                F.date_add(ordered, lead).alias("expected_date"),
                received.alias("received_date"),
                F.col("l_quantity").alias("ordered_qty"),
                F.when(F.col("l_orderkey") % 14 == 0, F.col("l_quantity") * 0.9)
                .otherwise(F.col("l_quantity")).alias("received_qty")))


def order_lines(spark, sf) -> DataFrame:
    """Order export: all text, with refunded, blank-SKU and return lines in it."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", _brand_type().alias("sku"))
    key = F.col("l_orderkey")
    return (table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.when(key % 97 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "sku")).alias("Lineitem sku"),
                F.when(key % 89 == 0, F.lit("-2"))
                .when(key % 83 == 0, F.lit("n/a"))
                .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("Lineitem quantity"),
                F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"),
                         F.lit(" 14:23:00 "), F.when(key % 2 == 0, F.lit("-0700"))
                         .otherwise(F.lit("-1000"))).alias("Created at"),
                F.when(F.col("l_returnflag") == "R", F.lit("Refunded")).otherwise(F.lit("paid"))
                .alias("Financial Status"),
                F.when(key % 13 == 0, F.lit(None).cast("string"))
                .otherwise(F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("string"))
                .alias("Lineitem price"),
                F.col("p_name").alias("Lineitem name")))


def purchase_orders(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    lines = po_lines(spark, sf).groupBy("po_id").agg(
        F.round(F.sum(F.col("qty") * F.coalesce("unit_cost", F.lit(0.0))), 2).alias("total_cost"),
        F.sum("qty").alias("total_units"))
    head = table(spark, sf, "orders").select(
        _po_id().alias("po_id"), _supplier_key(F.col("o_custkey") % 10).alias("supplier_id"),
        F.when(key % 23 == 0, F.lit("cancelled"))
        .when(F.col("o_orderstatus") == "F", F.lit("received"))
        .when(F.col("o_orderstatus") == "O", F.lit("placed"))
        .otherwise(F.lit("approved")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.date_add(F.to_date("o_orderdate"), 21).alias("needed_by"),
        (F.col("o_orderpriority") == "1-URGENT").alias("expedite_flag"))
    return head.join(lines, "po_id", "left").select(
        "po_id", "supplier_id", "status", "created_at", "needed_by",
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("total_units", F.lit(0.0)).alias("total_units"), "expedite_flag",
        F.lit(None).cast("string").alias("joint_replen_group"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("string").alias("notes"))


def _po_id(key="o_orderkey"):
    return F.concat(F.lit("PO-1995-"), F.lpad(F.col(key).cast("string"), 9, "0"))


def po_lines(spark, sf) -> DataFrame:
    skus = _skus(table(spark, sf, "part"), "brand_type").select("p_partkey", "sku_id", "p_retailprice")
    return (table(spark, sf, "lineitem").join(skus, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(_po_id("l_orderkey").alias("po_id"), "sku_id")
            .agg(F.sum("l_quantity").alias("qty"),
                 F.round(F.avg(F.when(F.col("l_orderkey") % 11 != 0, F.col("p_retailprice") * 0.6)), 2)
                 .alias("unit_cost")))


def po_status_log(spark, sf) -> DataFrame:
    """Status events per order; every 17th order skips the approval."""
    key = F.col("o_orderkey")
    path = (F.when(key % 23 == 0, F.array(F.lit("drafted"), F.lit("cancelled")))
            .when((key % 17 == 0) & (F.col("o_orderstatus") != "P"),
                  F.array(F.lit("drafted"), F.lit("placed")))
            .when(F.col("o_orderstatus") == "F",
                  F.array(*[F.lit(s) for s in ("drafted", "approved", "placed", "received")]))
            .when(F.col("o_orderstatus") == "O",
                  F.array(*[F.lit(s) for s in ("drafted", "approved", "placed")]))
            .otherwise(F.array(F.lit("drafted"), F.lit("approved"))))
    steps = table(spark, sf, "orders").select(
        _po_id().alias("po_id"), "o_orderdate", path.alias("path"))
    steps = steps.select("po_id", "o_orderdate", "path",
                         F.posexplode("path").alias("pos", "to_status"))
    return steps.select(
        "po_id",
        F.when(F.col("pos") > 0, F.element_at("path", F.greatest(F.col("pos"), F.lit(1))))
        .alias("from_status"),
        "to_status", F.lit("planner").alias("by_user"),
        (F.to_date("o_orderdate") + F.col("pos") * 2).cast("timestamp").alias("at"),
        F.lit(None).cast("string").alias("note"))


def op_events(spark, sf) -> DataFrame:
    """Timed operations: event type as operation, value as duration / spend."""
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("operation"), "value")
