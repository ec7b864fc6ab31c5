"""Expressions of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MAX_HOURS = 19.0
#: Fixed values of the usage rule: seats of a passenger aircraft, seats below which one may be a freighter, its payload.
PASSENGER_SEATS, FREIGHTER_SEATS, FREIGHTER_LBS = 40, 10, 20000


def empty_as_null(code: Column) -> Column:
    return F.nullif(code, F.lit(""))


def key_or_na(name: Column) -> Column:
    return F.coalesce(empty_as_null(name), F.lit("NA"))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, form: str = "asin") -> Column:
    """Kilometres by the haversine formula, null where a place is unknown; the asin form for routes, the atan2 form for hops."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    if form == "asin":
        return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))  # least() alone would turn null into 1
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def flight_hours(takeoff: Column, landed: Column, reported_seconds: Column) -> Column:
    """The clock's difference if it is between 0 and 19 hours, else the reported time if that is, else null."""
    clock = (F.unix_micros(landed) - F.unix_micros(takeoff)) / 3.6e9
    reported = reported_seconds / 3600.0
    return F.when((clock > 0) & (clock < MAX_HOURS), clock).when((reported >= 0) & (reported < MAX_HOURS), reported)


def passengers(seats: Column, load_factor: float) -> Column:
    return seats * F.lit(load_factor)


def wet_zero(lease: Column, value: Column) -> Column:
    return F.when(lease == "Wet", F.lit(0.0)).otherwise(value)


def age(delivered: Column, date: Column) -> Column:
    """Years, two places; null where either date is. greatest() alone would turn null into 0."""
    days = F.datediff(date, delivered)
    return F.when(days.isNotNull(), F.round(F.greatest(days, F.lit(0)) / F.lit(365.25), 2))


def block_hours(km: Column) -> Column:
    return F.lit(0.411) + km / F.lit(868.0)


def inferred_usage(usage: Column, seats: Column, payload: Column) -> Column:
    freighter = (F.coalesce(seats, F.lit(0)) < FREIGHTER_SEATS) & (F.coalesce(payload, F.lit(0)) >= FREIGHTER_LBS)
    return F.coalesce(empty_as_null(usage), F.when(seats >= PASSENGER_SEATS, "Passenger").when(freighter, "Freight / Cargo").otherwise("Passenger"))


def leg_class(haul_km: Column) -> Column:
    return F.when(haul_km < 2500, "short").otherwise("long")


def fleet_size_class(tails: Column) -> Column:
    return F.when(tails < 40, "small").otherwise("large")


def grounded(alt: Column, gspeed: Column, vspeed: Column, seen: Column, now: Column) -> Column:
    quiet = F.unix_timestamp(now) - F.unix_timestamp(seen)
    return ((alt < 500) & (gspeed < 50)) | (quiet > 7200) | ((quiet > 1800) & (alt < 10000) & (vspeed < -256))


def airframe(serial: Column, sub_series: Column, reg: Column) -> Column:
    """The serial within its sub-series where there is one, else the registration; never null."""
    by_serial = F.concat(F.lit("SN:"), serial, F.lit("|"), key_or_na(sub_series))
    return F.when(empty_as_null(serial).isNotNull(), by_serial).otherwise(F.concat(F.lit("REG:"), F.coalesce(reg, F.lit(""))))


def short_serial(serial: Column) -> Column:
    return F.regexp_replace(serial, "^.*-", "")


def shown_registration(reg: Column, serial: Column, sub_series: Column) -> Column:
    """Placeholders are empty or end in a dash; they get the sub-series and the serial's last part."""
    blank = F.lit("")
    own = F.concat(F.coalesce(reg, blank), F.coalesce(sub_series, blank), F.lit("-"), short_serial(F.coalesce(serial, blank)))
    return F.when((F.coalesce(reg, blank) == "") | reg.rlike("-$"), own).otherwise(reg)
