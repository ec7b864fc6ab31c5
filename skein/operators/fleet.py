"""Airframes: who flies in which month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import airframe, empty_as_null, inferred_usage, key_or_na, shown_registration
from .snapshots import DEAD, LIVE, ORDER, latest_by, latest_revisions_with

CARRIED = ["seats", "value", "usage", "delivery_date", "lease"]
REVISION = ["operator", "plan_type", "revision_id"]


def allowed_rows(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest revisions that name their operator, live or on order, with is_order and the airframe.

    The airframe is the serial within its sub-series (NA where that is null or empty), else the registration.
    """
    last = latest_revisions_with(snapshots).select(*REVISION)
    rows = snapshots.join(last, REVISION, "left_semi").where(F.col("status").isin(LIVE + ORDER))
    name = airframe(F.col("serial"), F.col("sub_series"), F.col("reg").cast("string"))
    return rows.withColumn("is_order", F.col("status").isin(ORDER)).withColumn("airframe", name)


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each airframe of an operator's sub-series: delivered rows before orders, then the newest. Orders need a
    serial and a delivery date, live rows a serial or a registration."""
    serial, reg = empty_as_null(F.col("serial")), empty_as_null(F.col("reg").cast("string"))
    known = F.when(F.col("is_order"), serial.isNotNull() & F.col("delivery_date").isNotNull()).otherwise(serial.isNotNull() | reg.isNotNull())
    rows = rows.where(known).withColumn("_sub", key_or_na(F.col("sub_series")))
    return latest_by(rows, ["operator", "_sub", "airframe"], [F.col("is_order").asc(), F.col("id").desc()]).drop("_sub")


def fleet_identity(snapshots: DataFrame) -> DataFrame:
    """One row of each airframe in the newest revisions, dead or alive: see one_each."""
    return one_each(allowed_rows(snapshots))


def not_dead(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Without airframes that have any retired or written off row in their operator's newest revisions, whatever other
    rows stand there: by serial, or by registration where the row has no serial."""
    last = latest_revisions_with(snapshots).select(*REVISION)
    gone = snapshots.join(last, REVISION, "left_semi").where(F.col("status").isin(DEAD))
    has = empty_as_null(F.col("serial")).isNotNull()
    by_serial, by_reg = (gone.select("operator", c).distinct() for c in ("serial", "reg"))
    alive = rows.where(has).join(by_serial, ["operator", "serial"], "left_anti")
    return alive.unionByName(rows.where(~has).join(by_reg, ["operator", "reg"], "left_anti"))


def build_fleet(snapshots: DataFrame, actuals: DataFrame, carried: list[str] = CARRIED) -> DataFrame:
    """The owned fleet that lives, and aircraft that flew for an operator in its last month without being its own.

    An operator's own registrations are those of all its live rows, before one row of each airframe is chosen; a tail that
    another operator owns is no reason to leave it out. actuals: operator, sub_series, master_series, reg, date, mon,
    flight_id and the carried columns. sub_series is NA where it is unknown; reg is as shown in reports.
    """
    alive = not_dead(allowed_rows(snapshots), snapshots)
    shown = shown_registration(F.col("reg").cast("string"), F.col("serial"), F.col("sub_series"))
    sub = key_or_na(F.col("sub_series")).alias("sub_series")
    owned = one_each(alive).select("operator", sub, "master_series", shown.alias("reg"), "airframe", "is_order", F.lit(False).alias("is_sup"), *carried)
    last = actuals.groupBy("operator").agg(F.max("mon").alias("mon"))  # one row an operator
    flew = actuals.join(F.broadcast(last), ["operator", "mon"], "left_semi").join(alive.select("operator", "reg").distinct(), ["operator", "reg"], "left_anti")
    flew = flew.withColumn("sub_series", key_or_na(F.col("sub_series")))
    flew = latest_by(flew, ["operator", "sub_series", "reg"], [F.col("date").desc(), F.col("flight_id").desc()])
    reg = F.col("reg").cast("string")
    sup = flew.select(
        "operator", "sub_series", "master_series", reg.alias("reg"), F.concat(F.lit("REG:"), reg).alias("airframe"), F.lit(False).alias("is_order"), F.lit(True).alias("is_sup"), *carried
    )
    return owned.unionByName(sup)


def fleet_types(fleet: DataFrame) -> DataFrame:
    """Per operator and sub-series the master series: that of its first airframe, own ones first. NA where unknown."""
    first = F.min_by(key_or_na(F.col("master_series")), F.struct("is_sup", "airframe"))
    return fleet.groupBy("operator", "sub_series").agg(first.alias("master_series"))


def in_service(fleet: DataFrame, months: DataFrame) -> DataFrame:
    """months: (operator, mon, ...). Each month with the aircraft delivered by its end; a live aircraft without a date is
    there already, and so is one that isn't owned but flew last."""
    end = F.last_day("mon")
    delivered = F.when(F.col("is_order"), F.col("delivery_date") <= end).otherwise(F.col("delivery_date").isNull() | (F.col("delivery_date") <= end))
    return months.join(fleet, "operator").where(F.col("is_sup") | delivered)


def active_fleet(fleet: DataFrame, months: DataFrame) -> DataFrame:
    return in_service(fleet, months.select("operator", "mon").distinct()).groupBy("operator", "sub_series", "mon").agg(F.count("*").alias("active"))


def coarse_usage(usage: Column) -> Column:
    """Passenger, Freight / Cargo (any label that holds one of these words) or Other; null for none."""
    label = empty_as_null(usage)
    freight = label.contains("Cargo") | label.contains("Freight")
    return F.when(label == "Passenger", label).when(freight, "Freight / Cargo").when(label.isNotNull(), "Other")


def usage_check(tails: DataFrame) -> DataFrame:
    """tails: (usage, seats, payload) of aircraft that flew. One row: on labels of passengers or freight, how often the rule
    for unlabelled aircraft agrees with them, and what it makes of those without a label."""
    rule = inferred_usage(F.lit(None).cast("string"), F.col("seats"), F.col("payload"))
    label = coarse_usage(F.col("usage"))
    freight, known = label == "Freight / Cargo", empty_as_null(F.col("usage")).isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return tails.agg(
        F.count("*").alias("tails"), count(known).alias("labelled"), count(label != "Other").alias("checked"), count(label == rule).alias("correct"), count(freight).alias("freighters"),
        count(freight & (rule == label)).alias("freighters_found"), count(~known & (rule == "Passenger")).alias("null_passenger"), count(~known & (rule != "Passenger")).alias("null_freight"),
    )
