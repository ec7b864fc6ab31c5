"""Queries that run as streams over the driver's tables, from start to end of what is there, and batch by batch."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import running_distance
from ..session import shared_dir, ship
from ..sources import sinks
from ..streaming import live
from ..streaming.state import BucketState
from .adaptors import POSITIONS_SQL, geo, positions
from .coverage_queries import SQL as BATCH_SQL

TAIL = dt.date(2024, 1, 29)
NEWEST = "reg long, fr24_id long, timestamp timestamp, lat double, lon double, alt double, gspeed double"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("fr24_id", "timestamp", (F.round("distance", 2) + F.lit(0.0)).alias("distance"), F.round("time_delta", 6).alias("time_delta"))


def positions_stream(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated samples with running distance, through a stateful operator with timers and a file sink."""
    ship(spark)
    live.rocksdb(spark)
    folder, rows = _folder(spark), positions(spark, d)
    rows.write.parquet(f"{folder}/in")
    out = live.with_distance(live.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), geo(spark, d))
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _shown(spark.read.parquet(f"{folder}/out"))


def positions_sink(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two batches that overlap, the second written twice: each is there once."""
    folder, rows = _folder(spark), positions(spark, d)
    early = rows.where("timestamp < '2024-01-20'")
    for number, batch in enumerate((early, rows, rows)):
        sinks.append_by_month(batch, folder, ["fr24_id", "timestamp"], batch_id=min(number, 1))
    return spark.read.parquet(folder).groupBy("month", "fr24_id").agg(F.count("*").alias("samples"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def state_stream(spark: SparkSession, d: str) -> DataFrame:
    """Newest sample of each aircraft, kept by a stream that stops and goes on when more files are there."""
    folder, rows = _folder(spark), positions(spark, d)
    schema = spark.createDataFrame([], NEWEST).schema
    state = BucketState(spark, f"{folder}/latest", schema, "reg", 16)
    parts = (rows.where("timestamp < '2024-01-15'"), rows.where("timestamp >= '2024-01-15'"))
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").select(*schema.names)
        query = stream.writeStream.foreachBatch(live.upsert_state(state, "timestamp")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return state.read().select("reg", "fr24_id", "timestamp", F.round("alt", 6).alias("alt"))


def late_tail(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all samples, of which those of every seventh flight's last days came late and were worked in after."""
    folder = _folder(spark)
    rows, places = positions(spark, d).withColumn("day", F.to_date("timestamp")), geo(spark, d)
    late = (F.col("fr24_id") % 7 == 0) & (F.col("day") >= F.lit(TAIL)) & (F.second("timestamp") % 2 == 0)
    rows.where(~late).repartition("day").write.partitionBy("day").parquet(f"{folder}/samples")
    samples = spark.read.schema(rows.schema).parquet(f"{folder}/samples")
    first = running_distance(samples, places).select("fr24_id", "reg", "timestamp", "lat", "lon", "distance", "time_delta", "day")
    first.repartition("day").write.partitionBy("day").parquet(f"{folder}/totals")
    rows.where(late).repartition("day").write.mode("append").partitionBy("day").parquet(f"{folder}/samples")
    samples = spark.read.schema(rows.schema).parquet(f"{folder}/samples")
    live.recompute_tail(samples, places, f"{folder}/totals", TAIL)
    return _shown(spark.read.parquet(f"{folder}/totals"))


QUERIES = {f.__name__: f for f in (positions_stream, positions_sink, state_stream, late_tail)}
SQL = {
    "positions_stream": BATCH_SQL["positions_distance"],
    "late_tail": BATCH_SQL["positions_distance"],
    "positions_sink": f"""WITH {POSITIONS_SQL} SELECT strftime(timestamp, '%Y-%m') AS month, fr24_id, count(*) AS samples, min(timestamp) AS first, max(timestamp) AS last
FROM (SELECT DISTINCT fr24_id, timestamp FROM positions) GROUP BY ALL""",
    "state_stream": f"WITH {POSITIONS_SQL} SELECT reg, fr24_id, timestamp, round(alt, 6) AS alt FROM positions QUALIFY row_number() OVER (PARTITION BY reg ORDER BY timestamp DESC) = 1",
}
