"""Stored-table schemas.

Ids and names are strings, calendar values are dates, every measure is a
double.  Spark does not enforce keys; uniqueness of (sku_id, date) is an
operator (`checks.check_duplicates`).
"""
from pyspark.sql import types as T


def _fields(*pairs):
    kinds = {
        "s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(),
        "b": T.BooleanType(), "t": T.TimestampType(),
    }
    return T.StructType([
        T.StructField(name.rstrip("!"), kinds[kind], not name.endswith("!"))
        for name, kind in pairs
    ])


PANEL_SCHEMA = _fields(
    ("sku_id!", "s"), ("date!", "d"), ("demand!", "f"), ("on_hand", "f"),
    ("lead_time_days", "f"), ("unit_cost", "f"), ("unit_price", "f"),
    ("supplier", "s"), ("category", "s"),
)
SUPPLIERS_SCHEMA = _fields(
    ("supplier_id!", "s"), ("name", "s"), ("contact_email", "s"), ("country", "s"),
    ("payment_terms", "s"), ("default_lead_time_days", "f"), ("lead_time_std_days", "f"),
    ("moq", "f"), ("case_pack", "f"), ("notes", "s"),
)
RECEIPTS_SCHEMA = _fields(
    ("receipt_id!", "s"), ("sku_id!", "s"), ("supplier_id!", "s"), ("ordered_date", "d"),
    ("expected_date", "d"), ("received_date", "d"), ("ordered_qty", "f"), ("received_qty", "f"),
)
PURCHASE_ORDERS_SCHEMA = _fields(
    ("po_id!", "s"), ("supplier_id", "s"), ("status!", "s"), ("created_at!", "t"),
    ("needed_by", "d"), ("total_cost", "f"), ("total_units", "f"), ("expedite_flag", "b"),
    ("joint_replen_group", "s"), ("assigned_to", "s"), ("approved_by", "s"), ("notes", "s"),
)
PO_LINES_SCHEMA = _fields(
    ("po_id!", "s"), ("sku_id!", "s"), ("qty!", "f"), ("unit_cost", "f"),
)
PO_STATUS_LOG_SCHEMA = _fields(
    ("po_id!", "s"), ("from_status", "s"), ("to_status!", "s"), ("by_user", "s"),
    ("at!", "t"), ("note", "s"),
)
TABLES = {
    "panel": PANEL_SCHEMA, "suppliers": SUPPLIERS_SCHEMA, "receipts": RECEIPTS_SCHEMA,
    "purchase_orders": PURCHASE_ORDERS_SCHEMA, "po_lines": PO_LINES_SCHEMA,
    "po_status_log": PO_STATUS_LOG_SCHEMA,
}

CANONICAL_FIELDS = tuple(f.name for f in PANEL_SCHEMA.fields[:3]) + (
    "on_hand", "lead_time_days", "unit_cost", "unit_price", "supplier", "category")
REQUIRED_FIELDS = ("sku_id", "date", "demand")
OPTIONAL_NUMERIC = ("on_hand", "lead_time_days", "unit_cost", "unit_price")
OPTIONAL_TEXT = ("supplier", "category")

# fixed values: period length in days, periods per year, season length
PERIOD_DAYS = {"D": 1.0, "W": 7.0, "M": 30.0}
PERIODS_PER_YEAR = {"D": 365.0, "W": 52.0, "M": 12.0}
SEASON_LENGTH = {"D": 7, "W": 52, "M": 12}
# fixed values: quantile grid of every forecast, with its column names
QUANTILE_LEVELS = (0.025, 0.1, 0.5, 0.9, 0.975)
QUANTILE_COLS = ("q025", "q10", "q50", "q90", "q975")
# fixed values: standard-normal scores of the grid
QUANTILE_Z = (-1.9599639845, -1.2815515655, 0.0, 1.2815515655, 1.9599639845)
