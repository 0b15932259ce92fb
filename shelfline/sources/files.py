"""Readers and writers for delimited files, stored tables, reports and exports."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import PANEL_SCHEMA, TABLES

SEPARATORS = (",", "\t", ";", "|")


def detect_separator(spark: SparkSession, path: str) -> str:
    """Most frequent of the four separators in the header line."""
    head = "".join(row.value for row in spark.read.text(path).head(1))
    counts = {s: head.count(s) for s in SEPARATORS}
    best = max(counts, key=counts.get)
    return best if counts[best] else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; types are applied later with try_cast."""
    return spark.read.csv(path, sep=detect_separator(spark, path), header=True,
                          inferSchema=False, encoding="UTF-8", mode="PERMISSIVE")


def load_dataset(spark: SparkSession, path: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    """Stored tables by name, each also registered as a temporary view."""
    out = {}
    for name in names:
        out[name] = spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")
        out[name].createOrReplaceTempView(name)
    return out


def conform(df: DataFrame, schema) -> DataFrame:
    """Select to a schema by name; columns the input lacks become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def write_table(df: DataFrame, name: str, path: str) -> None:
    conform(df, TABLES[name]).write.mode("overwrite").parquet(f"{path}/{name}")


def write_panel(df: DataFrame, path: str) -> None:
    """Replaces the stored panel.  Range partitioning by SKU and date keeps a SKU's
    rows in few files (tight min/max statistics) and splits a large SKU."""
    (conform(df, PANEL_SCHEMA)
     .repartitionByRange("sku_id", "date").sortWithinPartitions("sku_id", "date")
     .write.mode("overwrite").parquet(f"{path}/panel"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_forecasts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # the writer trims by default


# fixed values: columns of the SKU table export, in order
SKU_TABLE_COLUMNS = (
    "sku_id", "status", "category", "supplier", "abc_class", "xyz_class", "on_hand",
    "days_of_cover", "last_demand", "cv_demand", "revenue_annual", "lead_time_days")


def export_sku_table(df: DataFrame, path: str) -> None:
    write_csv(df.select(*SKU_TABLE_COLUMNS), path)
