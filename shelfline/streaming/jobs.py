"""Structured Streaming forms of the order roll-up, order states and latency rates, and a keyed sink for what they update."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampType

from ..operators.purchasing import ALLOWED_FROM, ALLOWED_PAIRS
from ..sources.exports import order_rows


def stream_demand(lines: DataFrame, late: str = "7 days") -> DataFrame:
    """Order lines to daily demand per SKU; rows later than the watermark are dropped.

    In update mode with `run_keyed`, every day is there, the ones that are still open with what has come so far."""
    r = order_rows(lines).withWatermark("ts", late)
    return r.groupBy(F.window("ts", "1 day").alias("w"), "sku_id").agg(
        F.sum("qty").alias("demand"),
        F.round(F.sum(F.coalesce("price", F.lit(0.0)) * F.col("qty")) / F.sum("qty"), 4).alias("unit_price")
    ).select("sku_id", F.to_date("w.start").alias("date"), "demand", "unit_price")


def stream_latency(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Event count and mean value per operation over sliding windows."""
    return (events.withWatermark("ts", late)
            .groupBy(F.window("ts", size, slide).alias("w"), "operation")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("window_start"), "operation", "n", "total"))


# ---- order states -----------------------------------------------------------------------------------

FINAL = tuple(s for s in ALLOWED_FROM if not any(s in before for before in ALLOWED_FROM.values()))
STATE_OUT = "po_id string, status string, since timestamp, n_events long, n_invalid long"


AT = TimestampType()


class OrderStates(StatefulProcessor):
    """Keeps an order's events, which are few, in one value state and puts them in event-time order at every batch: a late event
    takes its place in the past and does not overwrite a newer status.  Once an order is final, a timer `keep_days` after its last event clears it.

    An order costs one read and one write of its state, and timer calls only when it is or was final: every call goes to the JVM and back."""

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "at array<long>, to_status array<string>, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, status, timer = self.events.get() or ([], [], None)
        seen = [*zip(at, status), *((AT.toInternal(r["at"]), r["to_status"]) for r in rows)]
        seen.sort(key=lambda e: (e[0] is None, e[0], e[1] is None, e[1]))
        at, status = [e[0] for e in seen], [e[1] for e in seen]
        fine = (status[0] == "drafted") + sum(f"{a}>{b}" in ALLOWED_PAIRS for a, b in zip(status, status[1:]))
        due = at[-1] // 1000 + self.keep_ms if status[-1] in FINAL else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.events.update((at, status, due))
        yield Row(po_id=key[0], status=status[-1], since=AT.fromInternal(at[-1]), n_events=len(seen), n_invalid=len(seen) - fine)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


BUCKETS = 1024  # fixed value: orders that share a state; a stream's checkpoint goes with it
NO_TIME = 2 ** 63 - 1  # an event without time stands after all others
PACKED = pa.schema([("po_id", pa.string()), ("us", pa.int64()), ("to_status", pa.string())])


def _packed(events: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(events[PACKED.names], PACKED, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


class _Sorted:
    """Events in the order of (order, time, status), nulls last, and what OrderStates says of every order."""

    def __init__(self, events: pd.DataFrame, keep_ms: int, old: int = 0):
        """The first `old` events were there before."""
        order, ids = pd.factorize(events["po_id"], use_na_sentinel=False)
        status, names = pd.factorize(events["to_status"], sort=True)
        status = np.where(status < 0, len(names), status)
        us = events["us"].to_numpy(np.int64)
        by = np.lexsort((status, us, order))
        self.events, order, status, us = events.iloc[by], order[by], status[by], us[by]
        first = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        self.last, self.size = np.r_[first[1:], len(order)] - 1, np.diff(np.r_[first, len(order)])
        code = {x: i for i, x in enumerate(names)}
        wide = len(names) + 1
        steps = [code[a] * wide + code[b] for a, b in (p.split(">") for p in ALLOWED_PAIRS) if a in code and b in code]
        fine = np.isin(np.r_[0, status[:-1]] * wide + status, steps)
        fine[first] = status[first] == code.get("drafted", -1)
        self.fine = np.add.reduceat(fine.astype(np.int64), first)
        self.touched = np.logical_or.reduceat(by >= old, first)
        self.ids, self.us = ids[order[first]], us[self.last]
        # time that clears an order, NO_TIME for open ones and those without time
        final = np.isin(status[self.last], [code[x] for x in FINAL if x in code]) & (self.us < NO_TIME)
        self.due = np.where(final, self.us // 1000 + keep_ms, NO_TIME)

    def kept(self, orders: np.ndarray) -> pd.DataFrame:
        return self.events[np.repeat(orders, self.size)]


class OrderBuckets(StatefulProcessor):
    """OrderStates for many orders at a time: the events of all orders of a bucket are one packed value, sorted and counted as arrays.

    A bucket costs one read and one write of its state a batch and holds one timer, for the first of its orders to be cleared."""

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("events", "packed binary, timer long")

    def _keep(self, events: pd.DataFrame, due: np.ndarray, timer: int | None) -> None:
        first = int(due.min()) if len(due) and due.min() < NO_TIME else None
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if len(events):
            self.state.update((_packed(events), first))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packed, timer = self.state.get() or (None, None)
        new = pd.concat(list(rows), ignore_index=True)[PACKED.names]
        old = new.iloc[:0] if packed is None else _unpacked(packed)
        s = _Sorted(pd.concat([old, new], ignore_index=True) if len(old) else new, self.keep_ms, len(old))
        self._keep(s.events, s.due, timer)
        touched, last = s.touched, s.last[s.touched]
        yield pd.DataFrame({"po_id": s.ids[touched], "status": s.events["to_status"].to_numpy()[last], "us": s.us[touched],
                            "n_events": s.size[touched], "n_invalid": (s.size - s.fine)[touched]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is not None:
            s = _Sorted(_unpacked(held[0]), self.keep_ms)
            # the timer that fired is gone by itself; orders that the watermark has passed go together
            open_ = s.due >= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
            self._keep(s.kept(open_), s.due[open_], None)
        return iter(())

    def close(self) -> None:
        pass


def stream_po_state(log: DataFrame, late: str = "30 days", keep_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """Running state per order with a count of events the workflow does not allow; events older than the watermark are dropped.

    Orders share states in `buckets`, each rewritten by a batch that has one of its orders; with 0 buckets every order has its own
    (`OrderStates`), for streams of a few orders a batch over many kept ones."""
    log = log.withWatermark("at", late)
    if not buckets:
        return log.groupBy("po_id").transformWithState(
            statefulProcessor=OrderStates(keep_days), outputStructType=STATE_OUT, outputMode="Update", timeMode="eventTime")
    events = log.select(F.pmod(F.xxhash64("po_id"), F.lit(buckets)).alias("bucket"), "at", "po_id", F.coalesce(F.unix_micros("at"), F.lit(NO_TIME)).alias("us"), "to_status")
    out = events.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OrderBuckets(keep_days), outputStructType="po_id string, status string, us long, n_events long, n_invalid long",
        outputMode="Update", timeMode="eventTime")
    return out.select("po_id", "status", F.when(F.col("us") < NO_TIME, F.timestamp_micros("us")).alias("since"), "n_events", "n_invalid")


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# ---- sinks ------------------------------------------------------------------------------------------

def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the available input into Parquet by append: only windows that the watermark has closed."""
    (stream.writeStream.format("parquet").option("path", path).outputMode("append")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_keyed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the available input in update mode: the rows of each micro-batch go to a folder of its number, which a repeated
    batch overwrites.  `merged` reads one row per key.  State with timers needs the RocksDB store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    (stream.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).outputMode("update")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key: partial aggregates over the batch folders."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def compact(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """The merged rows as the first batch folder of a new table, which later batches go on with."""
    merged(spark, path, keys).write.mode("overwrite").parquet(f"{target}/batch=-1")
