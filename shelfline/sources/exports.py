"""Order exports, vendor header presets and wide daily sales."""
from pyspark.sql import DataFrame, functions as F

# fixed values: columns that identify an order export
ORDER_EXPORT_COLUMNS = ("Lineitem sku", "Lineitem quantity", "Created at", "Financial Status")
# fixed values: order statuses that are not demand
EXCLUDED_STATUSES = ("voided", "refunded", "cancelled", "canceled")

# fixed values: vendor headers and the canonical fields they feed
PRESETS = {
    "netsuite": {
        "Item": "sku_id", "Internal ID": "sku_id", "Tran Date": "date", "Quantity": "demand",
        "Item Rate": "unit_price", "Item Price": "unit_price", "Item Cost": "unit_cost",
        "Avg Cost": "unit_cost", "Vendor": "supplier", "Preferred Vendor": "supplier",
        "Item Category": "category", "Class": "category", "Quantity Available": "on_hand"},
    "sap": {
        "Material": "sku_id", "Pstng Date": "date", "Quantity": "demand",
        "Unit Price": "unit_price", "Moving Avg Price": "unit_cost", "Vendor": "supplier",
        "Supplier": "supplier", "Material Group": "category",
        "Unrestricted Use Stock": "on_hand"},
    "quickbooks": {
        "Product/Service": "sku_id", "Date": "date", "Quantity": "demand", "Rate": "unit_price",
        "Cost": "unit_cost", "Vendor": "supplier", "Category": "category",
        "Qty On Hand": "on_hand"},
    "square": {
        "Item": "sku_id", "SKU": "sku_id", "Date": "date", "Items Sold": "demand",
        "Quantity": "demand", "Price": "unit_price", "Cost": "unit_cost",
        "Category": "category", "Vendor": "supplier"},
}


def is_order_export(df: DataFrame) -> bool:
    return set(ORDER_EXPORT_COLUMNS) <= set(df.columns) and len(df.take(1)) > 0


def order_rows(df: DataFrame) -> DataFrame:
    """Order lines that count as demand: (sku_id, date, qty, price, name, ts)."""
    has = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    created = has("Created at")
    ts = F.coalesce(F.try_to_timestamp(created, F.lit("yyyy-MM-dd HH:mm:ss Z")),
                    F.try_to_timestamp(created, F.lit("yyyy-MM-dd HH:mm:ss")),
                    F.try_to_timestamp(created))
    return (df.select(
                F.trim(has("Lineitem sku")).alias("sku_id"), ts.alias("ts"),
                has("Lineitem quantity").try_cast("double").alias("qty"),
                has("Lineitem price").try_cast("double").alias("price"),
                has("Lineitem name").alias("name"),
                F.lower(F.trim(has("Financial Status"))).alias("status"))
            .where((F.col("sku_id") != "") & (F.col("qty") > 0) & F.col("ts").isNotNull()
                   & F.coalesce(~F.col("status").isin(*EXCLUDED_STATUSES), F.lit(True)))
            .withColumn("date", F.to_date("ts")))


def orders_to_panel(df: DataFrame) -> DataFrame:
    """Order lines rolled up to SKU x UTC day with a quantity-weighted price.

    Both group-bys aggregate before they shuffle, so a SKU with a large share of
    the lines is reduced where it is read.
    """
    rows = order_rows(df)
    daily = rows.groupBy("sku_id", "date").agg(
        F.sum("qty").alias("demand"),
        F.round(F.sum(F.coalesce("price", F.lit(0.0)) * F.col("qty")) / F.sum("qty"), 4)
        .alias("unit_price"),
        F.min(F.when(F.col("name").isNotNull(), F.struct("ts", "name"))).alias("_first"))
    by_sku = daily.groupBy("sku_id").agg(F.min("_first").getField("name").alias("category"))
    return (daily.drop("_first").join(by_sku, "sku_id")
            .select("sku_id", "date", "demand", "unit_price",
                    F.lit("shopify").alias("supplier"), "category"))


def apply_preset(df: DataFrame, vendor: str) -> DataFrame:
    """Rename a vendor's headers to canonical names; of several headers for one field
    the first listed that is present is used.  Day-first dotted dates are parsed."""
    picked = {}
    for header, field in PRESETS[vendor].items():
        if header in df.columns and field not in picked:
            picked[field] = header
    out = df.select(*[F.col(f"`{h}`").alias(f) for f, h in picked.items()])
    if "date" in picked:
        out = out.withColumn("date", F.coalesce(
            F.try_to_timestamp(F.col("date"), F.lit("dd.MM.yyyy")),
            F.try_to_timestamp(F.col("date"))).cast("date"))
    return out


def melt_sales(wide: DataFrame, calendar: DataFrame) -> DataFrame:
    """Wide daily sales (d_1 ... d_n) to one row per item and date."""
    days = [c for c in wide.columns if c.startswith("d_")]
    ids = [c for c in wide.columns if c not in days]
    long = wide.unpivot(ids, days, "d", "sales")
    # the calendar holds one row per d_ column, so its size is that of one row of `wide`
    return long.join(F.broadcast(calendar.select("d", "date")), "d").drop("d")


def sample_skus(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows of `n` SKUs picked by a seeded hash."""
    chosen = (df.select("sku_id").distinct()
              .orderBy(F.md5(F.concat("sku_id", F.lit(f":{seed}"))), "sku_id").limit(n))
    return df.join(chosen, "sku_id", "left_semi")


def first_skus(df: DataFrame, n: int) -> DataFrame:
    chosen = df.select("sku_id").distinct().orderBy("sku_id").limit(n)
    return df.join(chosen, "sku_id", "left_semi")
