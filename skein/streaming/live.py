"""Live positions as a stream: late and repeated samples, running distance, latest state."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.positions import running_distance
from ..operators.snapshots import latest_by
from ..sources.sinks import overwrite_partitions
from .state import BucketState

LATE = "2 days"
IDLE_MS = 1000  # of event time, beyond what the watermark waits
STATE = "lat double, lon double, total double, ts double"
OUT = "fr24_id long, reg long, timestamp timestamp, lat double, lon double, distance double, time_delta double"


def deduplicated(positions: DataFrame, late: str = LATE) -> DataFrame:
    """One sample of each (fr24_id, timestamp) within the time that late samples may take."""
    return positions.where("fr24_id IS NOT NULL AND timestamp IS NOT NULL").withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["fr24_id", "timestamp"])


def _hop(a: float, b: float, c: float, d: float) -> float:
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


class Distance(StatefulProcessor):
    """A flight's last position, total and time. Samples of one batch are taken in order of time and place.

    The state ends with a timer: IDLE_MS of event time after a flight's newest sample. As the watermark lags behind by the
    time that late samples may take, all samples that can still come have come by then. One that comes for a flight whose
    state has ended would begin anew; deduplication drops it as late before it gets here.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getValueState("flight", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lat, lon, total, ts = self.flight.get() if self.flight.exists() else (None, None, 0.0, None)
        frame = pd.concat(list(rows)).sort_values(["timestamp", "lat", "lon", "gspeed"], na_position="first")
        out = []
        for r in frame.itertuples():
            now = r.timestamp.timestamp()
            here = not (pd.isna(r.lat) or pd.isna(r.lon))
            if here and lat is not None and lon is not None:
                total += _hop(lat, lon, r.lat, r.lon)
            elif here:
                seed = r.gspeed * 1.825 / 5 if not pd.isna(r.gspeed) and r.gspeed >= 120 else 0.0
                total = _hop(r.olat, r.olon, r.lat, r.lon) if not pd.isna(r.olat) else seed
            delta = max(0.0, now - ts) if ts is not None else 0.0
            out.append((key[0], r.reg, r.timestamp, r.lat, r.lon, total, delta))
            lat, lon, ts = (r.lat, r.lon, now) if here else (None, None, now)
        self.flight.update((lat, lon, total, ts))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(frame["timestamp"].max().timestamp() * 1000) + IDLE_MS)
        yield pd.DataFrame(out, columns=["fr24_id", "reg", "timestamp", "lat", "lon", "distance", "time_delta"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.flight.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_distance(positions: DataFrame, places: DataFrame) -> DataFrame:
    """A stream of samples (deduplicated, with a watermark) with distance and time_delta: see Distance.

    A sample that is older than the state gets a step of 0 seconds and can't change what was given out; recompute_tail over
    the stored samples does that. The state is kept in the RocksDB store, which the session must name (see rocksdb).
    """
    known = F.broadcast(places.select(F.col("code").alias("origin"), F.col("lat").alias("olat"), F.col("lon").alias("olon")))  # a table of airports
    rows = positions.join(known, "origin", "left").select("fr24_id", "reg", "timestamp", "lat", "lon", "gspeed", "olat", "olon")
    return rows.groupBy("fr24_id").transformWithStateInPandas(Distance(), OUT, "Append", "EventTime")


def rocksdb(spark: SparkSession) -> None:
    """Names the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_state(positions: DataFrame) -> DataFrame:
    """The newest sample of each aircraft, for complete mode."""
    newest = F.max_by(F.struct("fr24_id", "timestamp", "lat", "lon", "alt", "gspeed"), "timestamp")
    return positions.groupBy("reg").agg(newest.alias("p")).select("reg", "p.*")


def upsert_state(state: BucketState, newest_by: str):
    """A foreachBatch function: the newest row of each key over the state and the batch."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        return latest_by(old.unionByName(rows), [state.key], [F.col(newest_by).desc()])

    def run(batch: DataFrame, batch_id: int) -> None:
        state.upsert(batch, batch_id, merge)

    return run


def recompute_tail(samples: DataFrame, places: DataFrame, path: str, since: dt.date) -> None:
    """Distances of the days from since on, anew from the stored samples, as late ones change all totals after them.

    samples: partitioned by day, deduplicated; path: the distances, partitioned by day as well. Only flights with samples
    in these days are read, from the first day that any of them has; that day is found by a scan of two columns, and the
    wide read is pruned to it. Days before since stay as they are: they are what a ledger calls final.
    """
    tail = samples.where(F.col("day") >= F.lit(since)).select("fr24_id").distinct()
    first = samples.select("fr24_id", "day").join(tail, "fr24_id", "left_semi").agg(F.min("day")).first()[0]
    if first is None:
        return
    rows = samples.where(F.col("day") >= F.lit(first)).join(tail, "fr24_id", "left_semi")
    fresh = running_distance(rows, places).where(F.col("day") >= F.lit(since))
    overwrite_partitions(fresh.select("fr24_id", "reg", "timestamp", "lat", "lon", "distance", "time_delta", "day"), path, ["day"])
