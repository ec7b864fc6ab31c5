"""Live positions in batch: running distance, time steps, current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import great_circle, grounded
from .snapshots import latest_by


def running_distance(positions: DataFrame, places: DataFrame) -> DataFrame:
    """Per sample the kilometres flown so far and the seconds since the sample before, in order of time.

    A hop needs a position here and in the sample before; a flight's first sample with a position is seeded from its
    origin, else by its speed (from 120 on), if no sample was before it or that one had no position. Samples without a
    position carry the total. Samples of one time follow each other by place and speed, each with its own total.
    """
    own = places.select(F.col("code").alias("_code"), F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    rows = positions.join(own, F.col("origin") == F.col("_code"), "left")
    order = ["timestamp", "lat", "lon", "gspeed", "origin"]
    w = Window.partitionBy("fr24_id").orderBy(*order)
    plat, plon, pts = F.lag("lat").over(w), F.lag("lon").over(w), F.lag("timestamp").over(w)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    seed = F.when(F.col("_olat").isNotNull(), great_circle(F.col("_olat"), F.col("_olon"), F.col("lat"), F.col("lon"), "atan2")).when(F.col("gspeed") >= 120, F.col("gspeed") * 1.825 / 5).otherwise(0.0)
    rows = rows.withColumn("_plat", plat).withColumn("_plon", plon).withColumn("_pts", pts)
    hop = great_circle(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"), "atan2")
    # A seed replaces the total, a hop adds to it: the total is the last seed and all hops since.
    seeds = placed & (F.col("_plat").isNull() | F.col("_plon").isNull())
    rows = rows.withColumn("_hop", F.when(~placed, 0.0).when(seeds, seed).otherwise(hop)).withColumn("_part", F.sum(seeds.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("_hop").over(Window.partitionBy("fr24_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    delta = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros("timestamp") - F.unix_micros("_pts")) / 1e6, F.lit(0.0)))
    return rows.withColumn("distance", total).withColumn("time_delta", delta).select(*positions.columns, "distance", "time_delta")


def current_positions(positions: DataFrame, now) -> DataFrame:
    """The newest sample of each aircraft, with its grounded flag."""
    rows = latest_by(positions.where("reg IS NOT NULL"), ["reg"], [F.col("timestamp").desc()])
    return rows.withColumn("is_grounded", grounded(F.col("alt"), F.col("gspeed"), F.col("vspeed"), F.col("timestamp"), now))


def current_flow(positions: DataFrame, now) -> DataFrame:
    """All samples of each aircraft's current or last flight."""
    last = latest_by(positions.where("reg IS NOT NULL"), ["reg"], [F.col("timestamp").desc()]).select("reg", "fr24_id")
    rows = positions.join(last, ["reg", "fr24_id"], "left_semi")
    return rows.withColumn("is_grounded", grounded(F.col("alt"), F.col("gspeed"), F.col("vspeed"), F.col("timestamp"), now))


def aircraft_state(current: DataFrame, batch: DataFrame, roster: DataFrame, now) -> DataFrame:
    """(reg, operator, status, last_update). The newest row of each aircraft over the state and the batch; aircraft of the
    roster that the batch doesn't have have landed as of now: they keep what else was known, and are taken in if nothing
    was."""
    merged = latest_by(current.unionByName(batch), ["reg"], [F.col("last_update").desc()])
    missing = roster.where("reg IS NOT NULL").select("reg").distinct().join(batch.select("reg").distinct(), "reg", "left_anti").withColumn("_missing", F.lit(True))
    rows = merged.join(missing, "reg", "full")
    gone = F.coalesce("_missing", F.lit(False))
    return rows.select("reg", "operator", F.when(gone, "landed").otherwise(F.col("status")).alias("status"), F.when(gone, now).otherwise(F.col("last_update")).alias("last_update"))
