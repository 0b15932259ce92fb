"""Streams over several micro-batches: order, lateness, expiry, repeated batches."""
import datetime as dt

from pyspark.sql import functions as F

from shelfline.streaming import jobs

LOG = "po_id string, to_status string, at timestamp"


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def drained(spark, tmp_path, batches, schema, make, keys):
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    jobs.run_keyed(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    return jobs.merged(spark, str(tmp_path / "out"), keys)


def test_late_events_do_not_overwrite(spark, tmp_path):
    batches = [[("P1", "placed", day(4)), ("P2", "drafted", day(1))], [("P1", "drafted", day(1)), ("P2", "received", day(2))], [("P1", "approved", day(3))]]
    got = {r.po_id: r for r in drained(spark, tmp_path, batches, LOG, lambda s: jobs.stream_po_state(s, "100 days", 500), ["po_id"]).collect()}
    assert (got["P1"].status, got["P1"].since, got["P1"].n_events, got["P1"].n_invalid) == ("placed", day(4), 3, 0)
    assert (got["P2"].status, got["P2"].n_events, got["P2"].n_invalid) == ("received", 2, 1) and len(got) == 2


def test_final_orders_are_forgotten(spark, tmp_path):
    batches = [[("P1", "drafted", day(0)), ("P1", "cancelled", day(1))], [("P2", "drafted", day(60))], [("P3", "drafted", day(61))], [("P1", "drafted", day(60))]]
    got = {r.po_id: r for r in drained(spark, tmp_path, batches, LOG, lambda s: jobs.stream_po_state(s, "5 days", 10), ["po_id"]).collect()}
    assert (got["P1"].status, got["P1"].n_events) == ("drafted", 1)  # its old events were cleared by the timer


def test_open_windows_are_there(spark, tmp_path):
    schema = "ts timestamp, operation string, value double"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0)], [(at(2, 5), "a", 4.0)], [(at(9, 0), "b", 8.0), (at(1, 6), "a", 100.0)]]
    make = lambda s: jobs.stream_latency(s, "2 hours", "1 hour", "1 hour")
    merged = drained(spark, tmp_path, batches, schema, make, ["window_start", "operation"])
    want = {(at(1), "a"): (3, 103.0), (at(2), "a"): (1, 4.0), (at(9), "b"): (1, 8.0)}
    # the late row comes within the watermark of its batch; the last window is open
    assert {(r.window_start, r.operation): (r.n, r.total) for r in merged.collect()} == want
    jobs.compact(spark, str(tmp_path / "out"), ["window_start", "operation"], str(tmp_path / "small"))
    again = jobs.merged(spark, str(tmp_path / "small"), ["window_start", "operation"])
    assert again.select(F.count("*")).first()[0] == 3


def test_order_states_spare_calls():
    """One read and one write of the state an order, and no timer call while it is open."""
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: (calls.append(name), self if name == "getValueState" else None)[1]

    states = jobs.OrderStates(10)
    states.init(Fake())
    rows = [{"at": day(2), "to_status": "approved"}, {"at": day(1), "to_status": "drafted"}]
    (out,) = states.handleInputRows(("P1",), iter(rows), None)
    assert (out.status, out.since, out.n_events, out.n_invalid) == ("approved", day(2), 2, 0)
    assert calls == ["getValueState", "get", "update"]
    list(states.handleInputRows(("P1",), iter([{"at": day(3), "to_status": "cancelled"}]), None))
    assert calls[3:] == ["get", "registerTimer", "update"]


def test_orders_of_a_bucket_keep_apart(spark, tmp_path):
    """One state of a bucket gives what a state an order gives: late events, expiry, events without time or status, equal ones."""
    batches = [[("P1", "drafted", day(0)), ("P1", "cancelled", day(1)), ("P2", "drafted", day(0)), ("P3", None, day(2)), (None, "drafted", day(3)), ("P4", "placed", None)],
               [("P2", "cancelled", day(2)), ("P5", "drafted", day(60))], [("P6", "drafted", day(61)), ("P6", "approved", day(61))],
               [("P1", "drafted", day(60)), ("P2", "placed", day(60)), ("P3", "drafted", day(59)), (None, "odd", day(58)), ("P6", "approved", day(61))]]
    got = []
    for buckets in (0, 1, 3):
        (at := tmp_path / str(buckets)).mkdir()
        rows = drained(spark, at, batches, LOG, lambda s: jobs.stream_po_state(s, "5 days", 10, buckets), ["po_id"]).collect()
        got.append({r.po_id: (r.status, r.since, r.n_events, r.n_invalid) for r in rows})
    assert got[0] == got[1] == got[2]
    assert got[0]["P1"] == ("drafted", day(60), 1, 0) and got[0]["P6"] == ("drafted", day(61), 3, 3) and got[0]["P4"][1] is None


def test_buckets_spare_calls():
    """Two orders of a bucket cost one read and one write of its state, not one each."""
    import pandas as pd
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: (calls.append(name), self if name == "getValueState" else None)[1]

    states = jobs.OrderBuckets(10)
    states.init(Fake())
    rows = pd.DataFrame({"po_id": ["P1", "P2", "P1"], "us": [2, 1, 1], "to_status": ["approved", "placed", "drafted"]})
    (out,) = states.handleInputRows((0,), iter([rows]), None)
    assert out.to_dict("list") == {"po_id": ["P1", "P2"], "status": ["approved", "placed"], "us": [2, 1], "n_events": [2, 1], "n_invalid": [0, 1]}
    assert calls == ["getValueState", "get", "update"]
