"""The panel: flights joined with snapshots, repaired, padded, merged and rolled up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import cell_date, contract_year, month, month_before, month_ordinal
from ..functions.places import attach_geo
from ..functions.scalars import age, empty_as_null, flight_hours, great_circle, key_or_na, passengers, wet_zero
from ..session import stored
from .snapshots import LIVE, authoritative, latest_by, latest_revisions, newest

ATTRIBUTES = ["operator", "sub_series", "master_series", "seats", "payload", "usage", "value", "delivery_date", "lease"]


def same_airport(origin: Column, dest: Column, km: Column) -> Column:
    """Three-valued: null where the distance is unknown and the codes differ."""
    return (origin == dest) | (km < 1)


def in_scope(operators: list[str] | None = None, regs: list | None = None) -> Column:
    """Whether a row is of the given operators or registrations (either will do). None means no limit."""
    if operators is None and regs is None:
        return F.lit(True)
    return F.col("operator").isin(operators or []) | F.coalesce(F.col("reg").isin(regs or []), F.lit(False))


def scoped(rows: DataFrame, operators: list[str] | None = None, regs: list | None = None) -> DataFrame:
    """The rows that are in scope."""
    return rows.where(in_scope(operators, regs))


def check_scope(snapshots: DataFrame, operators: list[str] | None = None, regs: list | None = None) -> None:
    """A scope that names nobody is an error, as is one in which no snapshot is."""
    if operators is None and regs is None:
        return
    if not operators and not regs:
        raise ValueError("a scope needs an operator or a registration")
    if scoped(snapshots, operators, regs).isEmpty():
        raise ValueError("no aircraft in scope")


def scoped_registrations(snapshots: DataFrame, since: dt.date, operators: list[str] | None = None, regs: list | None = None) -> DataFrame:
    """The registrations that the scope has from the month of since on, each once."""
    rows = scoped(snapshots, operators, regs).where(F.col("period") >= F.lit(since))
    return rows.where(F.col("reg").cast("string") != "").select("reg").distinct()


def fetch_starts(snapshots: DataFrame) -> DataFrame:
    """Per registration its first delivery and the day from which flights are looked for, a month before: some fly ahead of
    the recorded day. Aircraft without a delivery have no row."""
    first = snapshots.where("reg IS NOT NULL AND delivery_date IS NOT NULL").groupBy("reg").agg(F.min("delivery_date").alias("delivered"))
    return first.withColumn("start", month_before(F.col("delivered")))


def restamp(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """The contract years of rows that were assembled for another as_of; rows without a date keep theirs."""
    return rows.withColumn("cy", F.when(F.col("date").isNotNull(), contract_year(F.col("date"), as_of)).otherwise(F.col("cy")))


def with_route(flights: DataFrame) -> DataFrame:
    """flights with orig, dest_actual, dest_planned: adds origin and dest, and drops those without either end."""
    end = F.coalesce(empty_as_null(F.col("dest_actual")), empty_as_null(F.col("dest_planned")))
    rows = flights.withColumn("origin", empty_as_null(F.col("orig"))).withColumn("dest", end)
    return rows.where("origin IS NOT NULL AND dest IS NOT NULL")


def with_hours(flights: DataFrame) -> DataFrame:
    """flights with departed, landed (timestamps) and seconds (reported): adds hours."""
    return flights.withColumn("hours", flight_hours(F.col("departed"), F.col("landed"), F.col("seconds")))


def aircraft_months(snapshots: DataFrame, attributes: list[str], operators: list[str] | None = None, regs: list | None = None) -> DataFrame:
    """One row per aircraft of the scope: its months with the attributes of each as a map, and its last month.

    A row has the months of one aircraft, some hundreds at most, so flights find their attributes by a single join. The
    last month is taken over all operators: once another has an aircraft, later flights are the other's, whatever the
    scope, and no flight is counted for both. The snapshots are read once.
    """
    owned = authoritative(snapshots).select("reg", F.col("period").alias("key_month"), *attributes)
    own = F.when(in_scope(operators, regs), F.struct("key_month", F.struct(*attributes).alias("a")))  # collect_list leaves nulls out
    months = owned.groupBy("reg").agg(F.map_from_entries(F.collect_list(own)).alias("months"), F.max("key_month").alias("last_month"))
    return months.where(F.size("months") > 0)


def attributed(flown: DataFrame, aircraft: DataFrame, attributes: list[str], as_of: dt.date, load_factor: float) -> DataFrame:
    """flown (reg, date, ...) with the attributes of the aircraft in the flight's month (after its last one, in that), the
    contract year and the passengers; flights of months that the aircraft doesn't have go."""
    rows = flown.join(aircraft, "reg").withColumn("_a", F.try_element_at("months", F.least(month(F.col("date")), F.col("last_month")))).where("_a IS NOT NULL")
    rows = rows.select(*flown.columns, *[F.col(f"_a.{c}").alias(c) for c in attributes])
    return rows.withColumn("cy", contract_year(F.col("date"), as_of)).withColumn("pax", passengers(F.col("seats"), load_factor))


def assemble_actuals(
    flights: DataFrame, snapshots: DataFrame, as_of: dt.date, load_factor: float = 0.8, operators: list[str] | None = None, keep_unknown: bool = False,
    regs: list | None = None, since: dt.date | None = None,
) -> DataFrame:
    """flights: (flight_id, reg, date, origin, dest, hours, km). One row per flight after since and before as_of with the
    attributes of its aircraft in its month; flights after an aircraft's last snapshot month take that month's.

    Flights without an origin or a destination go. Flights between one airport go; so do those of unknown distance,
    unless keep_unknown. See assemble_reported for flights as a source reports them.
    """
    check_scope(snapshots, operators, regs)
    apart = same_airport(F.col("origin"), F.col("dest"), F.col("km"))
    flown = flights.where(F.col("date") < F.lit(as_of)).where("origin IS NOT NULL AND dest IS NOT NULL")
    flown = flown.where(F.col("date") > F.lit(since)) if since else flown
    flown = flown.where(~F.coalesce(apart, F.lit(False)) if keep_unknown else ~apart)
    flown = flown.select("flight_id", "reg", "date", "origin", "dest", "hours", "km")
    return attributed(flown, aircraft_months(snapshots, ATTRIBUTES, operators, regs), ATTRIBUTES, as_of, load_factor)


#: What a reported flight's route is told by, and the attributes of an aircraft, in the whole panel.
FULL_ROUTE = ["origin", "dest", "dest_actual", "origin_icao", "dest_icao", "dest_icao_actual"]
FULL_MEASURES = ["km", "hours", "reported_km", "reported_hours"]
FULL_ATTRIBUTES = ["operator", "sub_series", "master_series", "manufacturer", "seats", "usage", "value", "delivery_date", "lease_type", "lease", "lessor"]


def dest_codes() -> tuple[Column, Column]:
    """Where a flight ended: the actual destination, else the planned one, as IATA and as ICAO code."""
    return tuple(F.coalesce(empty_as_null(F.col(f"{c}_actual")), empty_as_null(F.col(c))) for c in ("dest", "dest_icao"))


def assemble_reported(
    flights: DataFrame, snapshots: DataFrame, by_iata: DataFrame, by_icao: DataFrame, as_of: dt.date, load_factor: float = 0.8,
    operators: list[str] | None = None, regs: list | None = None, since: dt.date | None = None,
) -> DataFrame:
    """Flights as they are reported (flight_id, reg, date, departed, landed, FULL_ROUTE, reported_km, reported_seconds) with
    distance, times and the attributes of their aircraft.

    Distance is the great circle between the airports' places, by IATA code and, field by field, else by ICAO code; time is
    the clock's, else the reported one. Flights without an ICAO origin or any ICAO destination go, as do those between one
    airport (as planned, or less than a kilometre apart) and those of unknown distance.
    """
    check_scope(snapshots, operators, regs)
    flown = flights.where(F.col("date") < F.lit(as_of))
    flown = flown.where(F.col("date") > F.lit(since)) if since else flown
    end_iata, end_icao = dest_codes()
    flown = flown.where(empty_as_null(F.col("origin_icao")).isNotNull() & end_icao.isNotNull())
    flown = flown.withColumns({"_oi": empty_as_null(F.col("origin")), "_oc": empty_as_null(F.col("origin_icao")), "_di": end_iata, "_dc": end_icao})
    flown = with_geography(flown, by_iata, by_icao, ("_oi", "_oc"), ("_di", "_dc"))
    flown = flown.withColumn("km", great_circle(F.col("origin_lat"), F.col("origin_lon"), F.col("dest_lat"), F.col("dest_lon")))
    flown = flown.where(~same_airport(F.col("_oi"), empty_as_null(F.col("dest")), F.col("km")))
    seconds = F.col("reported_seconds")
    flown = flown.withColumn("hours", flight_hours(F.col("departed"), F.col("landed"), seconds)).withColumn("reported_hours", flight_hours(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), seconds))
    flown = flown.select("flight_id", "reg", "date", month(F.col("date")).alias("mon"), "departed", "landed", *FULL_ROUTE, *FULL_MEASURES)
    return attributed(flown, aircraft_months(snapshots, FULL_ATTRIBUTES, operators, regs), FULL_ATTRIBUTES, as_of, load_factor)


def _implausible(hours: Column, km: Column) -> Column:
    return hours.isNull() | (hours < km / 1100.0) | (hours > km / 550.0 + 2)


ROUTE_KEY = ["operator", "origin", "dest"]


def _with_route_mean(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the mean of value over their route in a column name. Means are one row a route, stored, so that the fact
    rows stay where they are as long as that table is small enough to be broadcast; a busy route is no hot key then, and
    beyond that a sort-merge join reads it without a window."""
    known = F.col("origin").isNotNull() & F.col("dest").isNotNull() & (F.col("origin") != F.col("dest"))
    means = stored(rows.where(known).groupBy(*ROUTE_KEY).agg(F.avg(value).alias(name)))
    return rows.join(means, ROUTE_KEY, "left")


def route_impute(actuals: DataFrame) -> DataFrame:
    """Missing distances and implausible times take the route's mean (of its operator); what is still implausible for
    the distance becomes km / 800 + 0.5. actuals are read three times: they should be a stored table."""
    known = F.col("origin").isNotNull() & F.col("dest").isNotNull() & (F.col("origin") != F.col("dest"))
    rows = _with_route_mean(actuals, F.when(F.col("km") > 0, F.col("km")), "_km")
    rows = rows.withColumn("km", F.when(F.coalesce(F.col("km"), F.lit(0.0)) == 0, F.coalesce("_km", "km")).otherwise(F.col("km"))).drop("_km")
    bad = _implausible(F.col("hours"), F.col("km"))
    rows = _with_route_mean(rows, F.when((F.col("km") > 0) & ~bad, F.col("hours")), "_hours")
    rule = F.col("km") / 800.0 + 0.5
    rows = rows.withColumn("hours", F.when((F.col("km") > 0) & bad & known, F.coalesce("_hours", rule)).otherwise(F.col("hours"))).drop("_hours")
    still = (F.col("km") > 0) & _implausible(F.col("hours"), F.col("km"))
    return rows.withColumn("hours", F.when(still, rule).otherwise(F.col("hours"))).select(*actuals.columns)


def newest_rows(snapshots: DataFrame) -> DataFrame:
    """The newest row of each registration in the newest revision of its plan type (by period, one without being live,
    then by number)."""
    last = latest_revisions(snapshots.select("plan_type", "revision_id", "period").distinct()).select("plan_type", "revision_id")
    return latest_by(snapshots.where("reg IS NOT NULL").join(F.broadcast(last), ["plan_type", "revision_id"], "left_semi"), ["reg"], newest())


def future_aircraft(snapshots: DataFrame, as_of: dt.date, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """A row without a flight, and so without a contract year, for each aircraft of the newest revisions that is delivered
    after as_of."""
    rows = newest_rows(snapshots).where(F.col("delivery_date") > F.lit(as_of))
    return rows.select("reg", month(F.col("delivery_date")).alias("period"), F.lit(None).cast("string").alias("cy"), *attributes)


def flown_cells(actuals: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """One row per aircraft, month and contract year with flights: its first day, and the newest flight's attributes."""
    order = F.struct("date", "flight_id")
    return actuals.where("date IS NOT NULL").groupBy("reg", month(F.col("date")).alias("mon"), "cy").agg(
        F.min("date").alias("first"), F.max(order).alias("last"), F.max_by(F.struct(*attributes), order).alias("newest")
    )


def fleet_presence(snapshots: DataFrame, actuals: DataFrame, as_of: dt.date, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """A row without a flight for each (month, contract year) cell of an aircraft's life in which it did not fly.

    Aircraft: live ones, and those that flew in the last month of the actuals without being live. A life begins with the
    first flight, else with delivery, and ends with as_of. The flights are read once, into a row for each cell.
    """
    live = newest_rows(snapshots).where(F.col("status").isin(LIVE)).select("reg", *attributes)
    flown = stored(flown_cells(actuals, attributes))
    recent = flown.join(F.broadcast(flown.agg(F.max("mon").alias("mon"))), "mon")  # one row: the last month
    flew = recent.groupBy("reg").agg(F.max_by("newest", "last").alias("n")).select("reg", "n.*")
    tails = live.unionByName(flew.join(live, "reg", "left_anti"))
    first = flown.groupBy("reg").agg(F.min("first").alias("first_flight"))
    tails = tails.join(first, "reg", "left").withColumn("life_start", F.coalesce("first_flight", "delivery_date")).drop("first_flight")
    end = F.lit(as_of.replace(day=1))
    cells = tails.where(month(F.col("life_start")) <= end).withColumn("mon", F.explode(F.sequence(month(F.col("life_start")), end, F.expr("interval 1 month"))))
    cells = cells.withColumn("cy", F.explode(F.array_distinct(F.array(contract_year(F.col("mon"), as_of), contract_year(F.last_day("mon"), as_of)))))
    cells = cells.withColumn("cell", cell_date(F.col("mon"), F.col("cy"), as_of)).where((F.col("cell") >= F.col("life_start")) & (F.col("cell") <= F.lit(as_of)))
    return cells.join(flown.select("reg", "mon", "cy"), ["reg", "mon", "cy"], "left_anti").select("reg", "mon", "cy", *attributes)


TAIL = ["operator", "reg"]


def not_wet(lease: Column) -> Column:
    """Holds for a lease that isn't known."""
    return ~lease.eqNullSafe(F.lit("Wet"))


def value_table(panel: DataFrame) -> DataFrame:
    """(operator, reg, ord, av): per aircraft of an operator and month the largest positive value of rows that are not wet
    leases. By operator, as a later row of another would make a projected value rise."""
    rows = panel.where(F.col("date").isNotNull() & not_wet(F.col("lease")) & (F.col("value") > 0))
    return rows.groupBy(*TAIL, month_ordinal(F.col("date")).alias("ord")).agg(F.max("value").alias("av"))


def value_stats(values: DataFrame) -> DataFrame:
    """Last value and month, and the slope per month, which never rises; null slopes (one month) are 0."""
    slope = F.least(F.lit(0.0), F.coalesce(F.regr_slope("av", "ord"), F.lit(0.0)))
    return values.groupBy(*TAIL).agg(F.max_by("av", "ord").alias("last_av"), F.max("ord").alias("last_ord"), slope.alias("slope"))


def value_fill(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells: (operator, reg, ord). The last value at or before each month, else the earliest: an as-of join by union and
    window, over the months of one aircraft."""
    both = cells.select(*TAIL, "ord", F.lit(None).cast("double").alias("av"), F.lit(1).alias("_c")).unionByName(values.select(*TAIL, "ord", "av", F.lit(0).alias("_c")))
    back = Window.partitionBy(*TAIL).orderBy("ord", "_c").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*TAIL)
    first = F.min_by("av", F.when(F.col("av").isNotNull(), F.col("ord"))).over(whole)
    return both.withColumn("filled", F.coalesce(F.last("av", ignorenulls=True).over(back), first)).where("_c = 1").select(*TAIL, "ord", "filled")


def type_benchmark(snapshots: DataFrame) -> DataFrame:
    """Per sub-series (NA where unknown) the mean positive value, of all operators and leases, in the newest month of all,
    else in its year."""
    span = snapshots.agg(F.max("period").alias("_newest"))
    rows = snapshots.where(F.col("value") > 0).crossJoin(F.broadcast(span))  # one row
    month_mean = F.avg(F.when(F.col("period") == F.col("_newest"), F.col("value")))
    year_mean = F.avg(F.when(F.year("period") == F.year("_newest"), F.col("value")))
    return rows.groupBy(key_or_na(F.col("sub_series")).alias("sub_series")).agg(F.coalesce(month_mean, year_mean).alias("benchmark"))


def merge_panel(actuals: DataFrame, forecast: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Actuals (with stubs) and forecast in one panel with values and ages; rows without a date and a contract year go.

    A value is the filled one (actuals) or the projected one (forecast: last value plus slope, not below 0), else the
    row's own, else its type's benchmark; of wet leases 0. Rows without a date get neither filled nor projected values.
    Values by aircraft and month and benchmarks are stored, so that the rows are dealt once at most: for the former, where
    these are too many to be broadcast.
    """
    held = actuals.where("date IS NOT NULL OR cy IS NOT NULL").withColumn("data_type", F.lit("Actuals"))
    both = held.unionByName(forecast.withColumn("data_type", F.lit("Forecast")), allowMissingColumns=True).withColumn("ord", month_ordinal(F.col("date")))
    values = stored(value_table(actuals))
    past = value_fill(both.where("data_type = 'Actuals' AND ord IS NOT NULL").select(*TAIL, "ord").distinct(), values).withColumn("data_type", F.lit("Actuals"))
    ahead = both.where("data_type = 'Forecast' AND ord IS NOT NULL").select(*TAIL, "ord").distinct().join(value_stats(values), TAIL)
    projected = F.greatest(F.lit(0.0), F.col("last_av") + F.col("slope") * (F.col("ord") - F.col("last_ord")))
    filled = stored(past.unionByName(ahead.select(*TAIL, "ord", projected.alias("filled"), F.lit("Forecast").alias("data_type"))))
    bench = stored(type_benchmark(snapshots).withColumnRenamed("sub_series", "_sub"))
    rows = both.join(filled, [*TAIL, "data_type", "ord"], "left").join(bench, key_or_na(F.col("sub_series")) == F.col("_sub"), "left")
    agreed = wet_zero(F.col("lease"), F.coalesce("filled", "value", "benchmark"))
    return rows.withColumn("agreed_value", agreed).withColumn("age", age(F.col("delivery_date"), F.col("date"))).drop("filled", "benchmark", "ord", "_sub")


def grouped(panel: DataFrame) -> DataFrame:
    """Per aircraft, month and route: flights (rows with a date) and sums."""
    return panel.groupBy("reg", month(F.col("date")).alias("mon"), "origin", "dest").agg(F.count("date").alias("flights"), F.sum("km").alias("km"), F.sum("hours").alias("hours"), F.sum("pax").alias("pax"))


def grouped_by_registration(panel: DataFrame) -> DataFrame:
    """Per aircraft and month, over all routes: flights (rows with a date) and sums."""
    return panel.groupBy("reg", month(F.col("date")).alias("mon")).agg(F.count("date").alias("flights"), F.sum("km").alias("km"), F.sum("hours").alias("hours"), F.sum("pax").alias("pax"))


def aircraft_information(panel: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Per aircraft the attributes of its newest row; rows without a date come last."""
    return latest_by(panel, ["reg"], [F.col("date").desc_nulls_last(), F.col("flight_id").desc_nulls_last()]).select("reg", *attributes)


def airport_lookup(panel: DataFrame, places: DataFrame, end: str) -> DataFrame:
    """The airports at one end (origin or dest) of any row, with their geography."""
    return panel.where(F.col(end).isNotNull()).select(F.col(end).alias("code")).distinct().join(places, "code", "left")


def with_geography(panel: DataFrame, by_iata: DataFrame, by_icao: DataFrame, origin: tuple[str, str] = ("origin", "origin"), dest: tuple[str, str] = ("dest", "dest")) -> DataFrame:
    """Geography of both ends; origin and dest name the columns of the IATA and the ICAO code."""
    return attach_geo(attach_geo(panel, by_iata, by_icao, *origin, "origin"), by_iata, by_icao, *dest, "dest")


def contract_year_values(panel: DataFrame) -> DataFrame:
    """Per aircraft and contract year: value at its start and end, their mean, and the mean weighted by flights. Wet
    leases and values of 0 don't count."""
    rows = panel.where(not_wet(F.col("lease")) & (F.col("value") > 0))
    months = rows.groupBy("reg", "cy", month(F.col("date")).alias("mon")).agg(F.max("value").alias("v"), F.count("date").alias("n"))
    out = months.groupBy("reg", "cy").agg(F.min_by("v", "mon").alias("inception"), F.max_by("v", "mon").alias("end"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("weighted"))
    return out.withColumn("average", (F.col("inception") + F.col("end")) / 2)


def report_dates(panel: DataFrame) -> DataFrame:
    """All months between the panel's first and last date."""
    ends = panel.agg(month(F.min("date")).alias("a"), month(F.max("date")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("mon"))
