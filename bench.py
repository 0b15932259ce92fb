"""Headline timings; prints one JSON line.  BENCH_SF_DIR, BENCH_CPUS, BENCH_ONLY choose the run."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import functions as F  # noqa: E402

from shelfline.operators import checks, evaluation as ev, forecast as fo, inventory as inv, policies as po, quality, series, skus, suppliers as su  # noqa: E402
from shelfline.session import local_session, scratch_path  # noqa: E402
from shelfline.sources import derived as d, exports  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session("bench", CPUS, **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "16"})
    spark.sparkContext.setLogLevel("OFF")
    # part x week dense panel, written once: the queries start from a stored panel
    path = scratch_path(spark, "bench-panel")
    t = time.time()
    d.panel_pw(spark, SF).write.parquet(path)
    build = time.time() - t
    panel = spark.read.parquet(path)
    sup, rcp = d.suppliers(spark, SF), d.receipts(spark, SF)
    n = panel.count()
    freq, as_of = "W", "2001-12-31"
    monthly = d.panel_pm(spark, SF)
    queries = {
        "reorder_queue": lambda: inv.reorder_queue(panel, sup, freq, as_of),
        "abc_xyz": lambda: inv.abc_xyz(panel, 52.0),
        "stress_test": lambda: inv.stress_test(panel, sup, freq, 1.5, 1.25),
        "sku_table": lambda: skus.sku_table(panel, freq),
        "series_metrics": lambda: series.series_metrics(panel),
        "characterize": lambda: series.characterize(panel, freq),
        "dq_stationarity": lambda: quality.dq_stationarity(panel, freq),
        "decompose": lambda: series.decompose(panel, freq),
        "supplier_scorecards": lambda: su.supplier_scorecards(sup, rcp, panel),
        "orders_to_panel": lambda: exports.orders_to_panel(d.order_lines(spark, SF)),
        "check_duplicates": lambda: checks.check_duplicates(panel),
        "forecast_route_weekly": lambda: fo.rows(fo.classical_fc(fo.route_model(fo.to_series(panel), freq), 12, freq), "sku_id"),
        "backtest_croston_weekly": lambda: ev.backtest_summary(ev.backtest(fo.to_series(panel), freq, "croston", 4, 3)),
        "recommend_all": lambda: po.recommend_all(panel, fo.forecast_croston(panel, 12), freq),
        "cluster_cycles": lambda: su.cluster_cycles(su.replen_cycles(panel, 52.0)),
        "forecast_route_monthly": lambda: fo.rows(fo.classical_fc(fo.route_model(fo.to_series(monthly), "M"), 6, "M"), "sku_id"),
    }
    times = {"build_panel": round(build, 2)} if not ONLY else {}
    for name, make in queries.items():
        if ONLY and name not in ONLY:
            continue
        t = time.time()
        run(make())
        times[name] = round(time.time() - t, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": f"headline queries over {n} panel rows, total", "value": round(sum(times.values()), 2),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF)}))


main()
