"""Operators on dated snapshots of a fleet: rows of revisions, newest by (revision_id, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses as the snapshots have them. Any other (cancelled, planned, unknown) is no aircraft.
LIVE = ["In Service", "Storage"]
ORDER = ["On order", "On option", "LOI to Order", "LOI to Option", "Type swap", "Reengineered"]
DEAD = ["Retired", "Written off"]


def newest() -> list[Column]:
    return [F.col("revision_id").desc_nulls_last(), F.col("id").desc_nulls_last()]


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Keys that are null make one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """Per plan type the newest revision; one without a period is live and counts as newest."""
    return latest_by(revisions, ["plan_type"], [F.col("period").desc_nulls_first(), F.col("revision_id").desc()])


def latest_revisions_with(snapshots: DataFrame) -> DataFrame:
    """Per operator and plan type the newest revision in which the operator appears."""
    seen = snapshots.select("operator", "plan_type", "revision_id", "period").distinct()
    return latest_by(seen, ["operator", "plan_type"], [F.col("period").desc_nulls_first(), F.col("revision_id").desc()])


def authoritative(snapshots: DataFrame, operators: list[str] | None = None) -> DataFrame:
    """Per registration and month the newest row over all operators; only then the scope is applied. Rows without a
    registration are no one's and go."""
    rows = latest_by(snapshots.where("reg IS NOT NULL AND period IS NOT NULL"), ["reg", "period"], newest())
    return rows.where(F.col("operator").isin(operators)) if operators else rows


def snapshot_view(snapshots: DataFrame, plan: str | None = None, mode: str = "all") -> DataFrame:
    """all, historical (all but the newest revision of each plan type) or latest rows, of one plan type or of all."""
    rows = snapshots.where(F.col("plan_type") == plan) if plan else snapshots
    if mode == "all":
        return rows
    last = latest_revisions(snapshots.select("plan_type", "revision_id", "period").distinct()).select("plan_type", "revision_id")
    return rows.join(last, ["plan_type", "revision_id"], "left_semi" if mode == "latest" else "left_anti")


def snapshot_delta(snapshots: DataFrame, tracked: list[str]) -> DataFrame:
    """The newest row of each (reg, serial), and older rows whose tracked columns differ from it."""
    key = Window.partitionBy("reg", "serial").orderBy(*newest())
    rows = snapshots.withColumn("_k", F.row_number().over(key))
    whole = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.first(c).over(whole))
    return rows.withColumn("is_latest", F.col("_k") == 1).withColumn("_d", differs).where("is_latest OR _d").drop("_k", "_d")


def collapse_months(snapshots: DataFrame, current_month: Column) -> DataFrame:
    """Past months keep the newest row of each airframe; the current month stays as it is."""
    past = latest_by(snapshots.where(F.col("period") < current_month), ["plan_type", "period", "reg", "serial"], newest())
    return past.unionByName(snapshots.where(F.col("period").isNull() | (F.col("period") >= current_month)))


def latest_operator_status(snapshots: DataFrame) -> DataFrame:
    return latest_by(snapshots.where("reg IS NOT NULL"), ["reg"], newest()).select("reg", "operator", "status")


def active_roster(snapshots: DataFrame) -> DataFrame:
    """Registrations whose newest row is live."""
    return latest_operator_status(snapshots).where(F.col("status").isin(LIVE))


def roster_with_airlines(snapshots: DataFrame, airlines: DataFrame) -> DataFrame:
    """The active roster with the airline of each operator; airlines: (id, name), of one name the smallest id. An operator
    that is no airline has none, and its aircraft stay."""
    known = airlines.where("name IS NOT NULL").groupBy(F.col("name").alias("operator")).agg(F.min("id").alias("airline_id"))
    return active_roster(snapshots).join(known, "operator", "left").select(F.col("reg").cast("string").alias("reg"), "operator", F.col("airline_id").cast("long").alias("airline_id"))


def roster_changes(known: DataFrame, snapshots: DataFrame) -> DataFrame:
    """known: (reg). What to add and what to drop so that it equals the active roster. An empty roster changes nothing: it
    tells of a source that failed, not of a world without aircraft."""
    active = active_roster(snapshots).select("reg")
    there = active.agg(F.count("*").alias("_n")).where("_n > 0").select(F.lit(True).alias("_some"))  # one row, or none
    known = known.crossJoin(F.broadcast(there)).drop("_some")
    added = active.join(known, "reg", "left_anti").withColumn("change", F.lit("add"))
    return added.unionByName(known.join(active, "reg", "left_anti").withColumn("change", F.lit("drop")))
