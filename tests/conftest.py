import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from shelfline.schema import PANEL_SCHEMA  # noqa: E402
from shelfline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel_of(spark):
    """Weekly panel from {sku: [demand, ...]} with optional column overrides per row."""
    def make(series, step=7, start=dt.date(2024, 1, 1), **extra):
        rows = []
        for sku, values in series.items():
            for i, v in enumerate(values):
                row = dict(sku_id=sku, date=start + dt.timedelta(days=step * i), demand=None if v is None else float(v),
                           on_hand=None, lead_time_days=14.0, unit_cost=5.0, unit_price=10.0, supplier="Acme", category="FOODS_1")
                for k, f in extra.items():
                    row[k] = f(sku, i, len(values)) if callable(f) else f
                rows.append(tuple(row[c.name] for c in PANEL_SCHEMA.fields))
        schema = PANEL_SCHEMA
        for f in schema.fields:
            f.nullable = True
        return spark.createDataFrame(rows, schema)
    return make
