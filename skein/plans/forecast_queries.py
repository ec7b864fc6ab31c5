"""Queries of the fit, fleet, pool and projection operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fit as T
from ..operators import fleet as L
from ..operators import project as R
from ..session import stored
from .adaptors import ACTIVITY_SQL, AS_OF, SNAPSHOTS_SQL, activity, snapshots
from .panel_queries import rounded


def monthly_history(spark: SparkSession, d: str) -> DataFrame:
    return T.monthly_history(activity(spark, d), "sub_series")


def operator_frontier(spark: SparkSession, d: str) -> DataFrame:
    return T.operator_frontier(activity(spark, d))


def global_frontier(spark: SparkSession, d: str) -> DataFrame:
    return T.global_frontier(activity(spark, d))


def seasonal_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.fits(activity(spark, d), "sub_series")[0])


def robust_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.fits(activity(spark, d), "sub_series")[1])


def flown(spark: SparkSession, d: str) -> DataFrame:
    """Flights with what the fleet's supplement takes from them."""
    reg = F.col("reg")
    rows = activity(spark, d).withColumns({
        "value": F.col("price"), "usage": F.lit("Passenger"), "lease": F.when(reg % 9 == 0, "Wet").when(reg % 9 != 1, "Dry"),
        "delivery_date": F.date_add(F.lit("1994-01-01").cast("date"), ((reg * 37) % 3000).cast("int")),
    })
    return T.keyed(rows.drop("price"))


def last_facts(a: DataFrame) -> DataFrame:
    return a.groupBy("operator").agg(F.max("date").alias("last_fact"))


def _fleet(spark: SparkSession, d: str, a: DataFrame) -> DataFrame:
    return L.build_fleet(snapshots(spark, d), a)


def _plan(types: DataFrame, a: DataFrame) -> DataFrame:
    return T.month_plan(T.fit_two_grains(types, a), T.spans(last_facts(a), AS_OF))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Flights, fleet, its types and its plan, each stored: the projection reads them many times."""
    a = stored(flown(spark, d))
    fleet = stored(_fleet(spark, d, a))
    types = stored(L.fleet_types(fleet))
    return a, fleet, types, stored(_plan(types, a))


def month_plan(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, plan = _parts(spark, d)
    return rounded(plan.select("operator", "sub_series", "history_key", "mon", "start_day", "end_day", "span", "seas", "level", "base_fleet", "k"))


def fleet_identity(spark: SparkSession, d: str) -> DataFrame:
    return L.fleet_identity(snapshots(spark, d)).select("operator", "airframe", "reg", "status", "is_order")


def not_dead_fleet(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return L.not_dead(L.fleet_identity(s), s).select("operator", "airframe", "reg")


def fleet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fleet(spark, d, stored(flown(spark, d))))


def active_fleet(spark: SparkSession, d: str) -> DataFrame:
    a = stored(flown(spark, d))
    return L.active_fleet(_fleet(spark, d, a), T.spans(last_facts(a), AS_OF))


def route_pool_robust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.robust_pool(stored(flown(spark, d))), 4)


def route_pool_raw(spark: SparkSession, d: str) -> DataFrame:
    a = stored(flown(spark, d))
    return rounded(R.raw_pool(a, "sub_series", a), 4)


def pool_tier(spark: SparkSession, d: str) -> DataFrame:
    a, _, types, _ = _parts(spark, d)
    return R.choose_tier(types, a, R.robust_pool(a))


def forecast_flights(spark: SparkSession, d: str) -> DataFrame:
    a, fleet, types, plan = _parts(spark, d)
    pool = stored(R.robust_pool(a))
    tiers = stored(R.choose_tier(types, a, pool))
    flying = L.in_service(fleet, plan.select("operator", "mon").distinct())
    return rounded(R.generate_flights(flying, plan, tiers, stored(R.route_pools(a, tiers, pool)), AS_OF), 4)


def forecast_new_types(spark: SparkSession, d: str) -> DataFrame:
    """The projected flights of types that nobody has flown, by month and route: they have their master series' history
    and routes."""
    known = flown(spark, d).select("operator", "sub_series").distinct()
    new = forecast_flights(spark, d).join(known, ["operator", "sub_series"], "left_anti")
    return new.groupBy("operator", "sub_series", "mon", "tier", "origin", "dest").agg(F.count("*").alias("flights"), F.count_distinct("airframe").alias("aircraft"))


def forecast_coefficients(spark: SparkSession, d: str) -> DataFrame:
    a, fleet, _, plan = _parts(spark, d)
    active = L.active_fleet(fleet, plan.select("operator", "mon").distinct())
    return rounded(R.coefficients(R.plan_templates(plan, a, T.operator_frontier(a)), active))


def chart_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.chart_totals(forecast_coefficients(spark, d))


def chart_season(spark: SparkSession, d: str) -> DataFrame:
    return R.chart_season(forecast_coefficients(spark, d))


def chart_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.chart_rates(forecast_coefficients(spark, d))


def plan_months(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, plan = _parts(spark, d)
    own = F.col("grain") == "sub_series"
    return T.plan_months(plan.where(own), plan.where(~own))


def template_months(spark: SparkSession, d: str) -> DataFrame:
    a, _, _, plan = _parts(spark, d)
    return R.plan_templates(plan, a, T.operator_frontier(a)).select("operator", "sub_series", "mon", "template_month")


QUERIES = {
    f.__name__: f
    for f in (
        monthly_history, operator_frontier, global_frontier, seasonal_fit, robust_level, month_plan, fleet_identity, not_dead_fleet, fleet, active_fleet, route_pool_robust, route_pool_raw,
        pool_tier, forecast_flights, forecast_new_types, forecast_coefficients, chart_totals, chart_season, chart_rates, plan_months, template_months,
    )
}

#: The SQL below reads two tables: flown (flights with NA for unknown series) and snapshots.
FLOWN_SQL = """
flown AS (SELECT *, price AS value, 'Passenger' AS usage, CASE reg % 9 WHEN 0 THEN 'Wet' WHEN 1 THEN NULL ELSE 'Dry' END AS lease,
    CAST(DATE '1994-01-01' + CAST((reg * 37) % 3000 AS INTEGER) AS DATE) AS delivery_date FROM activity)"""


def fit_sql(name: str, key: str) -> str:
    """CTEs {name}_h (history to the frontier), {name}_seas and {name}_level for one grain."""
    return f"""
{name}_h AS (SELECT a.operator, {key} AS key, mon, frontier, count(*) AS flights, count(DISTINCT reg) AS tails FROM flown a JOIN frontiers f ON a.operator = f.operator WHERE mon <= frontier GROUP BY ALL),
{name}_per AS (SELECT operator, key, month(mon) AS cal, median(flights) AS med, count(*) AS n FROM {name}_h GROUP BY ALL),
{name}_base AS (SELECT operator, key, avg(med) AS base FROM {name}_per GROUP BY ALL),
{name}_seas AS (SELECT b.operator, b.key, c.cal, CASE WHEN n IS NULL THEN 1.0 ELSE greatest(n / (n + 3.0) * med / base + 1 - n / (n + 3.0), 0.10) END AS seas, coalesce(n, 0) AS n
  FROM {name}_base b CROSS JOIN (SELECT unnest(range(1, 13)) AS cal) c LEFT JOIN {name}_per p ON p.operator = b.operator AND p.key = b.key AND p.cal = c.cal),
{name}_d AS (SELECT h.*, flights / seas AS des, row_number() OVER (PARTITION BY h.operator, h.key ORDER BY mon DESC) AS k
  FROM {name}_h h JOIN {name}_seas s ON s.operator = h.operator AND s.key = h.key AND s.cal = month(mon)),
{name}_w AS (SELECT *, list_sort(list(des) OVER (PARTITION BY operator, key)) AS l FROM {name}_d WHERE k <= 15),
{name}_g AS (SELECT *, len(l) >= 3 AND des >= 0.85 * l[least(len(l) - 1, CAST(floor(len(l) * 0.75) AS INT)) + 1] AS good FROM {name}_w),
{name}_s AS (SELECT *, bool_or(good) OVER (PARTITION BY operator, key) AS any_good FROM {name}_g),
{name}_level AS (SELECT operator, key, median(des) AS level, CASE WHEN median(tails) = 0 THEN 1.0 ELSE median(tails) END AS base_fleet
  FROM {name}_s WHERE good OR (NOT any_good AND k <= 3) GROUP BY ALL)"""


FRONTIER_SQL = """
om AS (SELECT operator, mon, count(*) AS flights, row_number() OVER (PARTITION BY operator ORDER BY mon DESC) AS k FROM flown GROUP BY operator, mon),
frontiers AS (SELECT operator, max(mon) AS frontier FROM om JOIN (SELECT operator, median(flights) AS m FROM om WHERE k <= 9 GROUP BY operator) USING (operator)
  WHERE flights >= 0.6 * m GROUP BY operator)"""
FLEET_SQL = """
lastrev AS (SELECT operator, plan_type, arg_max(revision_id, (period, revision_id)) AS revision_id FROM (SELECT DISTINCT operator, plan_type, revision_id, period FROM snapshots) GROUP BY ALL),
latest AS (SELECT s.* FROM snapshots s JOIN lastrev USING (operator, plan_type, revision_id)),
allowed AS (SELECT *, status NOT IN ('In Service', 'Storage') AS is_order, coalesce(nullif(sub_series, ''), 'NA') AS sub,
    CASE WHEN coalesce(serial, '') <> '' THEN 'SN:' || serial || '|' || coalesce(nullif(sub_series, ''), 'NA') ELSE 'REG:' || coalesce(CAST(reg AS VARCHAR), '') END AS airframe
  FROM latest WHERE status IN ('In Service', 'Storage', 'On order', 'On option', 'LOI to Order', 'LOI to Option', 'Type swap', 'Reengineered')),
keyed AS (SELECT * FROM allowed
  WHERE CASE WHEN is_order THEN coalesce(serial, '') <> '' AND delivery_date IS NOT NULL ELSE coalesce(CAST(reg AS VARCHAR), '') <> '' OR coalesce(serial, '') <> '' END),
ident AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY operator, sub, airframe ORDER BY is_order, id DESC) = 1),
dead AS (SELECT operator, serial, reg FROM latest WHERE status IN ('Retired', 'Written off')),
alive AS (SELECT * FROM ident i WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.operator = i.operator AND CASE WHEN coalesce(i.serial, '') <> '' THEN d.serial = i.serial ELSE d.reg = i.reg END))"""
ACTIVE_SQL = """
own_regs AS (SELECT operator, reg FROM allowed i WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.operator = i.operator AND CASE WHEN coalesce(i.serial, '') <> '' THEN d.serial = i.serial ELSE d.reg = i.reg END)),
last_mon AS (SELECT operator, max(mon) AS mon FROM flown GROUP BY operator),
flew AS (SELECT f.* FROM flown f JOIN last_mon USING (operator, mon) WHERE NOT EXISTS (SELECT 1 FROM own_regs o WHERE o.operator = f.operator AND o.reg = f.reg)
  QUALIFY row_number() OVER (PARTITION BY f.operator, sub_series, f.reg ORDER BY date DESC, flight_id DESC) = 1),
fleet AS (
  SELECT operator, sub AS sub_series, master_series,
      CASE WHEN coalesce(CAST(reg AS VARCHAR), '') = '' OR CAST(reg AS VARCHAR) LIKE '%-'
        THEN coalesce(CAST(reg AS VARCHAR), '') || coalesce(sub_series, '') || '-' || regexp_replace(coalesce(serial, ''), '^.*-', '') ELSE CAST(reg AS VARCHAR) END AS reg,
      airframe, is_order, false AS is_sup, {carried} FROM alive
  UNION ALL SELECT operator, sub_series, master_series, CAST(reg AS VARCHAR), 'REG:' || reg, false, true, {carried} FROM flew),
types AS (SELECT operator, sub_series, arg_min(coalesce(nullif(master_series, ''), 'NA'), (is_sup, airframe)) AS master_series FROM fleet GROUP BY ALL),
facts AS (SELECT operator, CAST(max(date) + 1 AS DATE) AS fc FROM flown GROUP BY operator),
span0 AS (SELECT operator, fc, CAST(unnest(generate_series(date_trunc('month', fc)::TIMESTAMP, TIMESTAMP '2003-06-01', INTERVAL 1 MONTH)) AS DATE) AS mon FROM facts),
spans AS (SELECT operator, mon, day(last_day(mon)) AS dim, CASE WHEN mon = date_trunc('month', fc) THEN least(day(fc), day(last_day(mon))) ELSE 1 END AS start_day,
    CASE WHEN mon = DATE '2003-06-01' THEN 15 ELSE day(last_day(mon)) END AS end_day FROM span0),
flying AS (SELECT m.mon, f.* FROM (SELECT DISTINCT operator, mon FROM spans) m JOIN fleet f ON f.operator = m.operator
  WHERE is_sup OR CASE WHEN is_order THEN delivery_date <= last_day(mon) ELSE delivery_date IS NULL OR delivery_date <= last_day(mon) END),
active AS (SELECT operator, sub_series, mon, count(*) AS active FROM flying GROUP BY ALL)"""
CARRIED_SQL = "seats, value, usage, delivery_date, lease"
PLAN_SQL = (
    fit_sql("f", "sub_series")
    + ","
    + fit_sql("g", "master_series")
    + """,
grains AS (SELECT 'sub_series' AS grain, s.operator, s.key, cal, seas, level, base_fleet FROM f_seas s JOIN f_level l ON l.operator = s.operator AND l.key = s.key
  UNION ALL SELECT 'master_series', s.operator, s.key, cal, seas, level, base_fleet FROM g_seas s JOIN g_level l ON l.operator = s.operator AND l.key = s.key),
based AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM f_level x WHERE x.operator = t.operator AND x.key = t.sub_series) THEN 'sub_series' ELSE 'master_series' END AS grain FROM types t),
plan AS (SELECT s.operator, b.sub_series, b.master_series, b.grain, g.key AS history_key, s.mon, month(s.mon) AS cal, start_day, end_day, greatest(1, end_day - start_day + 1) AS span, dim, seas, level, base_fleet,
    greatest(1, CAST(round_even(level * seas / base_fleet * (greatest(1, end_day - start_day + 1) / dim), 0) AS INTEGER)) AS k
  FROM spans s JOIN based b ON b.operator = s.operator
  JOIN grains g ON g.operator = s.operator AND g.grain = b.grain AND g.cal = month(s.mon) AND g.key = CASE b.grain WHEN 'sub_series' THEN b.sub_series ELSE b.master_series END),
past AS (SELECT 'sub_series' AS grain, operator, key, mon FROM f_h UNION ALL SELECT 'master_series', operator, key, mon FROM g_h),
planned AS (SELECT p.*, frontier, coalesce((SELECT max(h.mon) FROM past h WHERE h.grain = p.grain AND h.operator = p.operator AND h.key = p.history_key AND month(h.mon) = p.cal),
    (SELECT max(h.mon) FROM past h WHERE h.grain = p.grain AND h.operator = p.operator AND h.key = p.history_key)) AS template_month
  FROM plan p JOIN frontiers f ON f.operator = p.operator),
coefficients AS (SELECT p.operator, p.master_series, p.sub_series, history_key, p.mon AS forecast_month, p.cal AS calendar_month, frontier, round(level, 6) AS level, round(CAST(base_fleet AS DOUBLE), 6) AS base_fleet,
    round(level / base_fleet, 6) AS per_aircraft_rate, round(seas, 6) AS seasonal_factor, round(span / dim, 6) AS proration, active AS active_fleet, k AS flights_per_aircraft,
    k * active AS forecast_flights, template_month
  FROM planned p JOIN active a ON a.operator = p.operator AND a.sub_series = p.sub_series AND a.mon = p.mon)"""
)


def pool_sql(route: str = "origin, dest", measures: str = "km, hours", order: str = "origin || '>' || dest || '#' || copy") -> str:
    """CTEs pool1, tiers and pools. The columns of a route are compared as one struct, so that nulls in them are equal."""
    ends = ", ".join(route.split(", ")[:2])
    medians = ", ".join(f"median({m}) AS {m}" for m in measures.split(", "))
    return f"""
routed AS (SELECT *, row({route}) AS route, month(date) AS cal, year(date) AS yr FROM flown),
rows_ AS (SELECT * FROM routed SEMI JOIN (SELECT operator, sub_series, route FROM routed GROUP BY ALL HAVING max(yr) > min(yr)) USING (operator, sub_series, route)),
counts AS (SELECT operator, sub_series, cal, route, yr, count(*) AS c FROM rows_ GROUP BY ALL),
years AS (SELECT DISTINCT operator, sub_series, cal, yr FROM routed),
firsts AS (SELECT operator, sub_series, cal, route, min(yr) AS first FROM counts GROUP BY ALL),
typical AS (SELECT operator, sub_series, cal, route, CAST(round_even(median(coalesce(c, 0)), 0) AS INTEGER) AS copies
  FROM firsts JOIN years USING (operator, sub_series, cal) LEFT JOIN counts USING (operator, sub_series, cal, route, yr) WHERE yr >= first GROUP BY ALL),
means AS (SELECT operator, sub_series, cal, route, {route}, {medians} FROM rows_ GROUP BY ALL),
copies AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM typical JOIN means USING (operator, sub_series, cal, route) WHERE copies >= 1),
pool1 AS (SELECT operator, sub_series, cal, {route}, {measures}, row_number() OVER (PARTITION BY operator, sub_series, cal ORDER BY md5({order}), {route.replace(",", " NULLS FIRST,")} NULLS FIRST, copy) AS rn FROM copies),
tiers AS (SELECT t.operator, t.sub_series, t.master_series, c.cal, CASE WHEN n1 >= 5 THEN 1 WHEN n2 >= 5 THEN 2 ELSE 3 END AS tier
  FROM types t CROSS JOIN (SELECT unnest(range(1, 13)) AS cal) c
  LEFT JOIN (SELECT operator, sub_series, count(DISTINCT row({ends})) AS n2 FROM flown GROUP BY ALL) a ON a.operator = t.operator AND a.sub_series = t.sub_series
  LEFT JOIN (SELECT operator, sub_series, cal, count(DISTINCT row({ends})) AS n1 FROM pool1 GROUP BY ALL) b ON b.operator = t.operator AND b.sub_series = t.sub_series AND b.cal = c.cal),
pools AS (SELECT operator, 1 AS tier, sub_series || '/' || cal AS pool, {route}, {measures}, rn FROM pool1
  UNION ALL SELECT operator, 2, sub_series, {route}, {measures}, row_number() OVER (PARTITION BY operator, sub_series ORDER BY md5(flight_id), flight_id) FROM flown
  UNION ALL SELECT operator, 3, master_series, {route}, {measures}, row_number() OVER (PARTITION BY operator, master_series ORDER BY md5(flight_id), flight_id) FROM flown)"""


def flights_sql(route: str = "origin, dest", measures: str = "km, hours", carried: str = CARRIED_SQL) -> str:
    """CTE generated: the projected flights."""
    own = ", ".join(f"CASE WHEN t.lease = 'Wet' THEN 0.0 ELSE t.value END AS value" if c == "value" else f"t.{c}" for c in carried.split(", "))
    ends = ", ".join(f"p.{c}" for c in (route + ", " + measures).split(", "))
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY operator, sub_series, mon ORDER BY airframe, reg) AS rank FROM flying),
gen AS (SELECT *, (rank - 1) * k + g - 1 AS gi FROM (SELECT r.*, p.k, p.cal, p.start_day, p.end_day, p.span, unnest(range(1, p.k + 1)) AS g
  FROM ranked r JOIN plan p ON p.operator = r.operator AND p.sub_series = r.sub_series AND p.mon = r.mon)),
tiered AS (SELECT g.*, t.tier, CASE t.tier WHEN 1 THEN g.sub_series || '/' || g.cal WHEN 2 THEN g.sub_series ELSE t.master_series END AS pool
  FROM gen g JOIN tiers t ON t.operator = g.operator AND t.sub_series = g.sub_series AND t.cal = g.cal),
sizes AS (SELECT operator, tier, pool, max(rn) AS n FROM pools GROUP BY ALL),
dated AS (SELECT t.operator, t.sub_series, t.mon, t.master_series, t.airframe, t.reg, t.gi, t.tier, {ends}, t.seats * 0.8 AS pax, {own},
    make_date(year(mon), month(mon), CAST(CASE WHEN start_day + gi % span <= CASE WHEN t.cal = 6 THEN 15 ELSE end_day END
      THEN greatest(start_day, least(end_day, CASE WHEN t.cal = 6 THEN 15 ELSE 16 END)) ELSE greatest(start_day, least(end_day, 16)) END AS INTEGER)) AS date
  FROM tiered t JOIN sizes s ON s.operator = t.operator AND s.tier = t.tier AND s.pool = t.pool
  JOIN pools p ON p.operator = t.operator AND p.tier = t.tier AND p.pool = t.pool AND p.rn = t.gi % s.n + 1),
generated AS (SELECT *, 'CY' || (year(date) - CASE WHEN month(date) < 6 OR (month(date) = 6 AND day(date) <= 15) THEN 1 ELSE 0 END) AS cy FROM dated)"""


_FRONTIER = f"WITH {ACTIVITY_SQL}, {FLOWN_SQL}, {FRONTIER_SQL}"
_FLEET = f"WITH {SNAPSHOTS_SQL}, {FLOWN_SQL}, {FLEET_SQL}, {ACTIVE_SQL.format(carried=CARRIED_SQL)}"
_PLAN = f"{_FLEET}, {FRONTIER_SQL}, {PLAN_SQL}"
_ALL = f"{_PLAN}, {pool_sql()}, {flights_sql()}"
SQL = {
    "monthly_history": f"WITH {ACTIVITY_SQL} SELECT operator, sub_series, mon, count(*) AS flights, count(DISTINCT reg) AS tails FROM activity GROUP BY ALL",
    "operator_frontier": f"{_FRONTIER} SELECT * FROM frontiers",
    "global_frontier": f"WITH {ACTIVITY_SQL}, m AS (SELECT mon, count(*) AS f FROM activity GROUP BY mon) SELECT max(mon) AS frontier FROM m WHERE f >= 0.6 * (SELECT median(f) FROM m)",
    "seasonal_fit": f"{_FRONTIER}, {fit_sql('f', 'sub_series')} SELECT operator, key AS sub_series, cal, round(seas, 6) AS seas, n FROM f_seas",
    "robust_level": f"{_FRONTIER}, {fit_sql('f', 'sub_series')} SELECT operator, key AS sub_series, round(level, 6) AS level, round(CAST(base_fleet AS DOUBLE), 6) AS base_fleet FROM f_level",
    "month_plan": f"""{_PLAN} SELECT operator, sub_series, history_key, mon, start_day, end_day, span, round(seas, 6) AS seas, round(level, 6) AS level,
  round(CAST(base_fleet AS DOUBLE), 6) AS base_fleet, k FROM plan""",
    "fleet_identity": f"WITH {SNAPSHOTS_SQL}, {FLEET_SQL} SELECT operator, airframe, reg, status, is_order FROM ident",
    "not_dead_fleet": f"WITH {SNAPSHOTS_SQL}, {FLEET_SQL} SELECT operator, airframe, reg FROM alive",
    "fleet": f"{_FLEET} SELECT * REPLACE (round(value, 6) AS value) FROM fleet",
    "active_fleet": f"{_FLEET} SELECT * FROM active",
    "route_pool_robust": f"{_ALL} SELECT operator, sub_series, cal, origin, dest, round(km, 4) AS km, round(hours, 4) AS hours, rn FROM pool1",
    "route_pool_raw": f"{_ALL} SELECT operator, pool AS sub_series, origin, dest, round(km, 4) AS km, round(hours, 4) AS hours, rn FROM pools WHERE tier = 2",
    "pool_tier": f"{_ALL} SELECT * FROM tiers",
    "forecast_flights": f"""{_ALL} SELECT operator, sub_series, mon, master_series, airframe, reg, gi, tier, origin, dest, round(km, 4) AS km, round(hours, 4) AS hours, date, cy,
  round(CAST(pax AS DOUBLE), 4) AS pax, seats, round(value, 4) AS value, usage, delivery_date, lease FROM generated""",
    "forecast_new_types": f"""{_ALL} SELECT operator, sub_series, mon, tier, origin, dest, count(*) AS flights, count(DISTINCT airframe) AS aircraft FROM generated g
  WHERE NOT EXISTS (SELECT 1 FROM flown f WHERE f.operator = g.operator AND f.sub_series = g.sub_series) GROUP BY ALL""",
    "forecast_coefficients": f"{_PLAN} SELECT * FROM coefficients",
    "chart_season": f"{_PLAN} SELECT DISTINCT operator, sub_series, calendar_month, seasonal_factor FROM coefficients",
    "chart_rates": f"{_PLAN} SELECT DISTINCT operator, sub_series, level, base_fleet, per_aircraft_rate FROM coefficients",
    "plan_months": f"{_PLAN} SELECT DISTINCT operator, mon FROM plan",
    "template_months": f"{_PLAN} SELECT operator, sub_series, mon, template_month FROM planned",
    "chart_totals": f"{_PLAN} SELECT forecast_month, CAST(sum(forecast_flights) AS BIGINT) AS flights, CAST(sum(active_fleet) AS BIGINT) AS aircraft FROM coefficients GROUP BY forecast_month",
}
