"""Queries of the snapshot and panel operators on the driver's tables, and their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import contract_year, month_ordinal
from ..functions.places import geo_lookup
from ..functions.scalars import inferred_usage, shown_registration
from ..operators import fleet as L
from ..operators import panel as P
from ..operators import snapshots as S
from ..operators.numbering import quantiles_within
from ..session import shared_dir, stored
from ..sources.readers import read_roster
from ..sources.sinks import store_roster
from .adaptors import ACTIVITY_SQL, AS_OF, SNAPSHOTS_SQL, activity, snapshots, table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places (and no negative zero), as the SQL has them."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def contract_year_rollup(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).groupBy("operator", contract_year(F.col("date"), AS_OF).alias("cy")).agg(F.count("*").alias("flights"), F.countDistinct("reg").alias("tails"))


def authoritative_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return S.authoritative(snapshots(spark, d)).select("id", "reg", "period", "operator", "status")


def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_revisions_with(snapshots(spark, d)).select("operator", "plan_type", "revision_id", "period")


def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_delta(snapshots(spark, d), ["status", "operator", "lease"]).select("id", "reg", "serial", "status", "operator", "is_latest")


def collapse_revisions(spark: SparkSession, d: str) -> DataFrame:
    return S.collapse_months(snapshots(spark, d), F.lit("2001-06-01").cast("date")).select("id", "reg", "period", "operator")


def roster_sync(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("reg"))
    return S.roster_changes(known, snapshots(spark, d))


def stored_roster(spark: SparkSession, d: str) -> DataFrame:
    """The active roster with its airlines, stored twice and read back."""
    path = f"{shared_dir(spark)}/roster-{uuid.uuid4().hex}"
    airlines = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    roster = S.roster_with_airlines(snapshots(spark, d), airlines.unionByName(airlines.withColumn("id", F.col("id") + 100)))
    store_roster(roster.limit(0), path)
    store_roster(roster, path)
    return read_roster(spark, path)


def _places(spark: SparkSession, d: str, prio: int, miss: int) -> DataFrame:
    """One source of geography, with fields that are empty or null for some of its codes."""
    n = table(spark, d, "nation")
    base = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    return base.select("code", F.lit(prio).alias("prio"), F.when(F.col("code") % miss == 0, "").otherwise(F.concat("name", F.lit(f" {prio}"))).alias("city"), F.when(F.col("code") % (miss + 1) != 0, F.concat(F.lit("R"), "r", F.lit(f" {prio}"))).alias("country"), F.concat(F.lit(f"A{prio} "), "name").alias("airport_name"), F.when(F.col("code") % miss != 0, F.col("code") * 1.5).alias("lat"), F.when(F.col("code") % (miss + 2) != 0, F.col("code") * 2.5).alias("lon"))


def geo_pick(spark: SparkSession, d: str) -> DataFrame:
    return geo_lookup(_places(spark, d, 1, 2).unionByName(_places(spark, d, 2, 3)).unionByName(_places(spark, d, 3, 5)))


def geo_attach(spark: SparkSession, d: str) -> DataFrame:
    by_iata = geo_lookup(_places(spark, d, 1, 2).unionByName(_places(spark, d, 2, 3)))
    return P.with_geography(_actuals(spark, d).select("flight_id", "origin", "dest"), by_iata, geo_lookup(_places(spark, d, 3, 5))).drop("origin", "dest")


def airport_lookups(spark: SparkSession, d: str) -> DataFrame:
    a, places = stored(_actuals(spark, d).select("origin", "dest").distinct()), geo_pick(spark, d)
    ends = [P.airport_lookup(a, places, e).withColumn("at", F.lit(e)) for e in ("origin", "dest")]
    return ends[0].unionByName(ends[1])


def great_circle_routes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(activity(spark, d).groupBy("origin", "dest").agg(F.max("km").alias("km"), F.count("*").alias("flights")), 4)


def _actuals(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """known: the snapshots, of a query that reads them elsewhere too."""
    return P.assemble_actuals(activity(spark, d), snapshots(spark, d) if known is None else known, AS_OF)


def assemble_actuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_actuals(spark, d).select("flight_id", "reg", "date", "operator", "cy", "km", "hours", "pax", "value"), 4)


def route_impute(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.route_impute(stored(_actuals(spark, d).select("flight_id", *P.ROUTE_KEY, "km", "hours"))).select("flight_id", "km", "hours"), 4)


def future_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return P.future_aircraft(snapshots(spark, d), dt.date(1998, 1, 15)).select("reg", "period", "cy", "operator", "delivery_date")


def fleet_presence(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return P.fleet_presence(s, _actuals(spark, d, s), AS_OF, ["operator", "delivery_date"]).select("reg", "mon", "cy", "operator", "delivery_date")


def value_fill(spark: SparkSession, d: str) -> DataFrame:
    a = stored(_actuals(spark, d).select(*P.TAIL, "date", "lease", "value"))
    cells = a.select("operator", "reg").distinct().join(activity(spark, d).select("reg", month_ordinal(F.col("date")).alias("ord")).distinct(), "reg")
    return rounded(P.value_fill(cells, P.value_table(a)))


def value_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.value_stats(P.value_table(_actuals(spark, d))))


def type_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.type_benchmark(snapshots(spark, d)))


def merge_panel(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    a = stored(_actuals(spark, d, s).select("flight_id", *P.TAIL, "date", "cy", "sub_series", "value", "delivery_date", "lease"))
    ahead = a.withColumn("date", F.add_months("date", 24))
    return rounded(P.merge_panel(a, ahead, s).select("flight_id", "data_type", "reg", "date", "agreed_value", "age"), 4)


def grouped_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.grouped(_actuals(spark, d)), 3)


def grouped_registration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.grouped_by_registration(_actuals(spark, d)), 3)


def aircraft_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.aircraft_information(_actuals(spark, d)))


def report_dates(spark: SparkSession, d: str) -> DataFrame:
    return P.report_dates(_actuals(spark, d))


def restamp(spark: SparkSession, d: str) -> DataFrame:
    return P.restamp(_actuals(spark, d), dt.date(2001, 2, 28)).groupBy("operator", "cy").agg(F.count("*").alias("flights"))


def scope_registrations(spark: SparkSession, d: str) -> DataFrame:
    return P.scoped_registrations(snapshots(spark, d), dt.date(1997, 1, 1), ["ASIA", "EUROPE B"])


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.assemble_actuals(activity(spark, d), snapshots(spark, d), AS_OF, operators=["ASIA", "EUROPE B"], since=dt.date(1996, 6, 15)).select("flight_id", "reg", "date", "operator")


def fetch_starts(spark: SparkSession, d: str) -> DataFrame:
    return P.fetch_starts(snapshots(spark, d))


def snapshot_views(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    parts = [S.snapshot_view(s, plan, mode).select("id", F.lit(plan or "full").alias("plan"), F.lit(mode).alias("mode")) for plan, mode in (("Business", "latest"), ("Commercial", "historical"), (None, "latest"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shown_registrations(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("reg") % 5 == 0, "A6-").otherwise(F.concat(F.lit("A6-"), F.col("reg")))
    tail = F.when(F.col("reg") % 7 == 0, "").when(F.col("reg") % 7 != 1, tail)
    return snapshots(spark, d).select("id", shown_registration(tail, F.col("serial"), F.col("sub_series")).alias("shown"))


def distance_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Per operator, some of whom hold a large part of all rows: exact quantiles of distance."""
    return rounded(quantiles_within(activity(spark, d), ["operator"], "km", {"low": 0.1, "half": 0.5, "high": 0.975}), 4)


def cy_weighted_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.contract_year_values(_actuals(spark, d)))


def usage_infer(spark: SparkSession, d: str) -> DataFrame:
    return _usage(snapshots(spark, d))


def _usage(known: DataFrame) -> DataFrame:
    s = S.latest_by(known, ["reg"], S.newest())
    seats = F.when(F.col("reg") % 5 == 0, F.col("reg") % 30).otherwise(F.col("seats"))
    return s.select("reg", "usage", seats.alias("seats"), "payload", inferred_usage(F.col("usage"), seats, F.col("payload")).alias("effective"))


def usage_validate(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    flown = _actuals(spark, d, s).select("reg").distinct()
    return L.usage_check(_usage(s).join(flown, "reg", "left_semi"))


AS_OF_SQL = "DATE '2001-06-15'"
CY = "'CY' || CAST(year({d}) - CASE WHEN month({d}) < 6 OR (month({d}) = 6 AND day({d}) <= 15) THEN 1 ELSE 0 END AS VARCHAR)"
AUTH_SQL = SNAPSHOTS_SQL + ",\nowned AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY reg, period ORDER BY revision_id DESC, id DESC) AS k FROM snapshots WHERE reg IS NOT NULL) WHERE k = 1)"
ACTUALS_SQL = (
    AUTH_SQL
    + f"""
, actuals AS (
  SELECT a.flight_id, a.reg, a.date, a.origin, a.dest, a.hours, a.km, o.operator, o.sub_series, o.master_series, o.seats, o.payload, o.usage, o.value, o.delivery_date, o.lease,
         {CY.format(d="a.date")} AS cy, o.seats * 0.8 AS pax
  FROM activity a JOIN (SELECT reg, max(period) AS last_month FROM owned GROUP BY reg) m ON a.reg = m.reg
  JOIN owned o ON o.reg = a.reg AND o.period = least(a.mon, m.last_month)
  WHERE a.date < {AS_OF_SQL} AND NOT (a.origin = a.dest OR a.km < 1)
), vals AS (
  SELECT operator, reg, year(date) * 12 + month(date) AS ord, max(value) AS av FROM actuals WHERE lease IS DISTINCT FROM 'Wet' AND value > 0 GROUP BY ALL
), stats AS (
  SELECT operator, reg, max_by(av, ord) AS last_av, max(ord) AS last_ord, least(0.0, CASE WHEN count(*) > 1 THEN coalesce(regr_slope(av, ord), 0.0) ELSE 0.0 END) AS slope
  FROM vals GROUP BY operator, reg
), bench AS (
  SELECT coalesce(nullif(sub_series, ''), 'NA') AS sub_series, coalesce(avg(value) FILTER (WHERE period = mx), avg(value) FILTER (WHERE year(period) = year(mx))) AS benchmark
  FROM snapshots, (SELECT max(period) AS mx FROM snapshots) WHERE value > 0 GROUP BY ALL
), newest AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY revision_id DESC, id DESC) AS k FROM snapshots s
    WHERE reg IS NOT NULL AND revision_id = (SELECT t.revision_id FROM snapshots t WHERE t.plan_type = s.plan_type ORDER BY t.period DESC NULLS FIRST, t.revision_id DESC LIMIT 1)) WHERE k = 1
)"""
)
BAD = "({h} IS NULL OR {h} < {k} / 1100.0 OR {h} > {k} / 550.0 + 2)"
LIVE_SQL = "('In Service', 'Storage')"

QUERIES = {
    f.__name__: f
    for f in (
        contract_year_rollup, authoritative_snapshot, latest_revision, snapshot_delta, collapse_revisions, roster_sync, stored_roster, geo_pick,
        great_circle_routes, assemble_actuals, route_impute, future_aircraft, fleet_presence, value_fill, value_slope, type_benchmark, merge_panel,
        grouped_panel, cy_weighted_value, usage_infer, usage_validate, geo_attach, airport_lookups, grouped_registration, aircraft_information, report_dates,
        restamp, scope_registrations, scope_filter, fetch_starts, snapshot_views, shown_registrations, distance_quantiles,
    )
}

_GEO = "SELECT n_nationkey AS code, {p} AS prio, CASE WHEN n_nationkey % {m} <> 0 THEN n_name || ' {p}' END AS city, CASE WHEN n_nationkey % ({m} + 1) <> 0 THEN 'R' || n_regionkey || ' {p}' END AS country, 'A{p} ' || n_name AS airport_name, CASE WHEN n_nationkey % {m} <> 0 THEN n_nationkey * 1.5 END AS lat, CASE WHEN n_nationkey % ({m} + 2) <> 0 THEN n_nationkey * 2.5 END AS lon FROM nation"
_USAGE = "(SELECT reg, usage, CAST(CASE WHEN reg % 5 = 0 THEN reg % 30 ELSE seats END AS BIGINT) AS seats, payload FROM (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY revision_id DESC, id DESC) AS k FROM snapshots) WHERE k = 1)"
_RULE = "CASE WHEN seats >= 40 THEN 'Passenger' WHEN coalesce(seats, 0) < 10 AND coalesce(payload, 0) >= 20000 THEN 'Freight / Cargo' ELSE 'Passenger' END"

_FIELDS = ("city", "country", "airport_name", "lat", "lon")
_PICK = "SELECT code, " + ", ".join(f"arg_min({c}, prio) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _FIELDS)
_PICKED = f"{_PICK} FROM ({_GEO.format(p=1, m=2)} UNION ALL {_GEO.format(p=2, m=3)} UNION ALL {_GEO.format(p=3, m=5)}) GROUP BY code"
_NEWEST = "SELECT plan_type, revision_id FROM (SELECT plan_type, revision_id, row_number() OVER (PARTITION BY plan_type ORDER BY period DESC NULLS FIRST, revision_id DESC) AS k FROM (SELECT DISTINCT plan_type, revision_id, period FROM snapshots)) WHERE k = 1"
SQL = {
    "geo_attach": f"""WITH {ACTUALS_SQL}, i AS ({_PICK} FROM ({_GEO.format(p=1, m=2)} UNION ALL {_GEO.format(p=2, m=3)}) GROUP BY code), c AS ({_PICK} FROM ({_GEO.format(p=3, m=5)}) GROUP BY code)
SELECT flight_id, """
    + ", ".join(f"coalesce({e[0]}i.{c}, {e[0]}c.{c}) AS {e}_{c}" for e in ("origin", "dest") for c in _FIELDS)
    + " FROM actuals LEFT JOIN i oi ON oi.code = origin LEFT JOIN c oc ON oc.code = origin LEFT JOIN i di ON di.code = dest LEFT JOIN c dc ON dc.code = dest",
    "airport_lookups": f"WITH {ACTUALS_SQL}, p AS ({_PICKED}) SELECT p.*, 'origin' AS at FROM p WHERE code IN (SELECT origin FROM actuals) UNION ALL SELECT p.*, 'dest' FROM p WHERE code IN (SELECT dest FROM actuals)",
    "grouped_registration": f"WITH {ACTUALS_SQL} SELECT reg, CAST(date_trunc('month', date) AS DATE) AS mon, count(date) AS flights, round(sum(km), 3) AS km, round(sum(hours), 3) AS hours, round(CAST(sum(pax) AS DOUBLE), 3) AS pax FROM actuals GROUP BY ALL",
    "aircraft_information": f"WITH {ACTUALS_SQL} SELECT reg, operator, sub_series, master_series, seats, payload, usage, round(value, 6) AS value, delivery_date, lease FROM (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY date DESC, flight_id DESC) AS k FROM actuals) WHERE k = 1",
    "report_dates": f"WITH {ACTUALS_SQL} SELECT CAST(unnest(generate_series(date_trunc('month', min(date))::TIMESTAMP, date_trunc('month', max(date))::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS mon FROM actuals",
    "restamp": f"WITH {ACTUALS_SQL} SELECT operator, 'CY' || (year(date) - CASE WHEN month(date) < 2 OR (month(date) = 2 AND day(date) <= 28) THEN 1 ELSE 0 END) AS cy, count(*) AS flights FROM actuals GROUP BY ALL",
    "scope_registrations": f"WITH {SNAPSHOTS_SQL} SELECT DISTINCT reg FROM snapshots WHERE reg IS NOT NULL AND operator IN ('ASIA', 'EUROPE B') AND period >= DATE '1997-01-01'",
    "scope_filter": f"WITH {ACTUALS_SQL} SELECT flight_id, reg, date, operator FROM actuals WHERE operator IN ('ASIA', 'EUROPE B') AND date > DATE '1996-06-15'",
    "fetch_starts": f"WITH {SNAPSHOTS_SQL} SELECT reg, min(delivery_date) AS delivered, CAST(min(delivery_date) - INTERVAL 1 MONTH AS DATE) AS start FROM snapshots WHERE reg IS NOT NULL AND delivery_date IS NOT NULL GROUP BY reg",
    "snapshot_views": f"""WITH {SNAPSHOTS_SQL}, n AS ({_NEWEST}), s AS (SELECT id, plan_type, (plan_type, revision_id) IN (SELECT (plan_type, revision_id) FROM n) AS last FROM snapshots)
SELECT id, 'Business' AS plan, 'latest' AS mode FROM s WHERE last AND plan_type = 'Business' UNION ALL SELECT id, 'Commercial', 'historical' FROM s WHERE NOT last AND plan_type = 'Commercial' UNION ALL SELECT id, 'full', 'latest' FROM s WHERE last""",
    "shown_registrations": f"""WITH {SNAPSHOTS_SQL}, t AS (SELECT *, CASE WHEN reg % 7 = 0 THEN '' WHEN reg % 7 = 1 THEN NULL WHEN reg % 5 = 0 THEN 'A6-' ELSE 'A6-' || reg END AS tail FROM snapshots)
SELECT id, CASE WHEN coalesce(tail, '') = '' OR tail LIKE '%-' THEN coalesce(tail, '') || coalesce(sub_series, '') || '-' || regexp_replace(coalesce(serial, ''), '^.*-', '') ELSE tail END AS shown FROM t""",
    "contract_year_rollup": f"WITH {ACTIVITY_SQL} SELECT operator, {CY.format(d='date')} AS cy, count(*) AS flights, count(DISTINCT reg) AS tails FROM activity GROUP BY ALL",
    "authoritative_snapshot": f"WITH {AUTH_SQL} SELECT id, reg, period, operator, status FROM owned",
    "latest_revision": f"WITH {SNAPSHOTS_SQL} SELECT operator, plan_type, max(revision_id) AS revision_id, max(period) AS period FROM snapshots GROUP BY ALL",
    "snapshot_delta": f"""WITH {SNAPSHOTS_SQL}, c AS (SELECT *, row_number() OVER w AS k, first_value(status) OVER w AS s0, first_value(operator) OVER w AS o0, first_value(lease) OVER w AS l0 FROM snapshots WINDOW w AS (PARTITION BY reg, serial ORDER BY revision_id DESC, id DESC))
SELECT id, reg, serial, status, operator, k = 1 AS is_latest FROM c WHERE k = 1 OR status IS DISTINCT FROM s0 OR operator IS DISTINCT FROM o0 OR lease IS DISTINCT FROM l0""",
    "collapse_revisions": f"WITH {SNAPSHOTS_SQL} SELECT id, reg, period, operator FROM (SELECT *, row_number() OVER (PARTITION BY plan_type, period, reg, serial ORDER BY revision_id DESC, id DESC) AS k FROM snapshots) WHERE k = 1 OR period >= DATE '2001-06-01'",
    "roster_sync": f"""WITH {SNAPSHOTS_SQL}, a AS (SELECT reg FROM (SELECT reg, status, row_number() OVER (PARTITION BY reg ORDER BY revision_id DESC, id DESC) AS k FROM snapshots WHERE reg IS NOT NULL) WHERE k = 1 AND status IN {LIVE_SQL}), n AS (SELECT s_suppkey AS reg FROM supplier WHERE s_suppkey % 2 = 0)
SELECT reg, 'add' AS change FROM a WHERE reg NOT IN (SELECT reg FROM n) UNION ALL SELECT reg, 'drop' FROM n WHERE reg NOT IN (SELECT reg FROM a)""",
    "stored_roster": f"""WITH {SNAPSHOTS_SQL} SELECT CAST(reg AS VARCHAR) AS reg, operator, CAST(r_regionkey AS BIGINT) AS airline_id
FROM (SELECT * FROM snapshots WHERE reg IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reg ORDER BY revision_id DESC, id DESC) = 1) s LEFT JOIN region ON r_name = operator WHERE status IN {LIVE_SQL}""",
    "geo_pick": _PICKED,
    "distance_quantiles": f"""WITH {ACTIVITY_SQL} SELECT operator, round(quantile_cont(km, 0.1), 4) AS low, round(quantile_cont(km, 0.5), 4) AS half,
  round(quantile_cont(km, 0.975), 4) AS high FROM activity GROUP BY operator""",
    "great_circle_routes": f"WITH {ACTIVITY_SQL} SELECT origin, dest, round(max(km), 4) AS km, count(*) AS flights FROM activity GROUP BY ALL",
    "assemble_actuals": f"WITH {ACTUALS_SQL} SELECT flight_id, reg, date, operator, cy, round(km, 4) AS km, round(hours, 4) AS hours, round(CAST(pax AS DOUBLE), 4) AS pax, round(value, 4) AS value FROM actuals",
    "route_impute": f"""WITH {ACTUALS_SQL}, m AS (SELECT operator, origin, dest, avg(hours) AS mean FROM actuals WHERE km > 0 AND NOT {BAD.format(h="hours", k="km")} GROUP BY ALL),
r AS (SELECT flight_id, km, CASE WHEN {BAD.format(h="hours", k="km")} THEN coalesce(mean, km / 800.0 + 0.5) ELSE hours END AS h FROM actuals LEFT JOIN m USING (operator, origin, dest))
SELECT flight_id, round(km, 4) AS km, round(CASE WHEN {BAD.format(h="h", k="km")} THEN km / 800.0 + 0.5 ELSE h END, 4) AS hours FROM r""",
    "future_aircraft": f"WITH {ACTUALS_SQL} SELECT reg, CAST(date_trunc('month', delivery_date) AS DATE) AS period, CAST(NULL AS VARCHAR) AS cy, operator, delivery_date FROM newest WHERE delivery_date > DATE '1998-01-15'",
    "fleet_presence": f"""WITH {ACTUALS_SQL}, live AS (SELECT reg, operator, delivery_date FROM newest WHERE status IN {LIVE_SQL}),
flew AS (SELECT reg, operator, delivery_date FROM (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY date DESC, flight_id DESC) AS k FROM actuals) WHERE k = 1 AND date_trunc('month', date) = (SELECT date_trunc('month', max(date)) FROM actuals)),
tails AS (SELECT * FROM live UNION ALL SELECT * FROM flew WHERE reg NOT IN (SELECT reg FROM live)),
life AS (SELECT t.*, coalesce(f.first_flight, t.delivery_date) AS life_start FROM tails t LEFT JOIN (SELECT reg, min(date) AS first_flight FROM actuals GROUP BY reg) f USING (reg)),
months AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', life_start)::TIMESTAMP, TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS DATE) AS mon FROM life WHERE date_trunc('month', life_start) <= DATE '2001-06-01'),
cells AS (SELECT DISTINCT reg, operator, delivery_date, life_start, mon, {CY.format(d="d")} AS cy FROM (SELECT *, mon AS d FROM months UNION ALL SELECT *, last_day(mon) AS d FROM months)),
dated AS (SELECT *, make_date(year(mon), month(mon), least(CASE WHEN month(mon) = 6 AND CAST(right(cy, 4) AS INT) = year(mon) - 1 THEN 15 ELSE 16 END, day(last_day(mon)))) AS cell FROM cells)
SELECT reg, mon, cy, operator, delivery_date FROM dated c WHERE cell >= life_start AND cell <= {AS_OF_SQL} AND NOT EXISTS (SELECT 1 FROM actuals a WHERE a.reg = c.reg AND date_trunc('month', a.date) = c.mon AND a.cy = c.cy)""",
    "value_fill": f"""WITH {ACTUALS_SQL}, cells AS (SELECT DISTINCT o.operator, a.reg, year(a.date) * 12 + month(a.date) AS ord FROM activity a JOIN (SELECT DISTINCT operator, reg FROM actuals) o ON o.reg = a.reg)
SELECT operator, reg, ord, round(coalesce((SELECT max_by(av, v.ord) FROM vals v WHERE v.operator = c.operator AND v.reg = c.reg AND v.ord <= c.ord),
  (SELECT min_by(av, v.ord) FROM vals v WHERE v.operator = c.operator AND v.reg = c.reg)), 6) AS filled FROM cells c""",
    "value_slope": f"WITH {ACTUALS_SQL} SELECT operator, reg, round(last_av, 6) AS last_av, last_ord, round(slope, 6) + 0.0 AS slope FROM stats",
    "type_benchmark": f"WITH {ACTUALS_SQL} SELECT sub_series, round(benchmark, 6) AS benchmark FROM bench",
    "merge_panel": f"""WITH {ACTUALS_SQL}, both_ AS (SELECT *, 'Actuals' AS data_type FROM actuals UNION ALL SELECT * REPLACE (CAST(date + INTERVAL 24 MONTH AS DATE) AS date), 'Forecast' FROM actuals),
o AS (SELECT *, year(date) * 12 + month(date) AS ord FROM both_),
f AS (SELECT DISTINCT operator, reg, ord, data_type FROM o),
g AS (SELECT f.*, CASE WHEN data_type = 'Actuals' THEN coalesce((SELECT max_by(av, v.ord) FROM vals v WHERE v.operator = f.operator AND v.reg = f.reg AND v.ord <= f.ord),
    (SELECT min_by(av, v.ord) FROM vals v WHERE v.operator = f.operator AND v.reg = f.reg))
  ELSE (SELECT CASE WHEN last_av + slope * (f.ord - last_ord) < 0 THEN 0.0 ELSE last_av + slope * (f.ord - last_ord) END FROM stats s WHERE s.operator = f.operator AND s.reg = f.reg) END AS filled FROM f)
SELECT flight_id, o.data_type, o.reg, o.date, round(CASE WHEN lease = 'Wet' THEN 0.0 ELSE coalesce(filled, value, benchmark) END, 4) + 0.0 AS agreed_value,
       round(round(greatest(date_diff('day', delivery_date, o.date), 0) / 365.25, 2), 4) AS age
FROM o LEFT JOIN g ON o.operator = g.operator AND o.reg = g.reg AND o.ord = g.ord AND o.data_type = g.data_type LEFT JOIN bench b ON b.sub_series = coalesce(nullif(o.sub_series, ''), 'NA')""",
    "grouped_panel": f"WITH {ACTUALS_SQL} SELECT reg, CAST(date_trunc('month', date) AS DATE) AS mon, origin, dest, count(date) AS flights, round(sum(km), 3) AS km, round(sum(hours), 3) AS hours, round(CAST(sum(pax) AS DOUBLE), 3) AS pax FROM actuals GROUP BY ALL",
    "cy_weighted_value": f"""WITH {ACTUALS_SQL}, m AS (SELECT reg, cy, date_trunc('month', date) AS mon, max(value) AS v, count(date) AS n FROM actuals WHERE lease IS DISTINCT FROM 'Wet' AND value > 0 GROUP BY ALL)
SELECT reg, cy, round(min_by(v, mon), 6) AS inception, round(max_by(v, mon), 6) AS "end", round(sum(v * n) / sum(n), 6) AS weighted, round((min_by(v, mon) + max_by(v, mon)) / 2, 6) AS average FROM m GROUP BY reg, cy""",
    "usage_infer": f"WITH {SNAPSHOTS_SQL} SELECT reg, usage, seats, payload, coalesce(nullif(usage, ''), {_RULE}) AS effective FROM {_USAGE}",
    "usage_validate": f"""WITH {ACTUALS_SQL}, u AS (SELECT nullif(usage, '') AS usage, {_RULE} AS rule FROM {_USAGE} x WHERE x.reg IN (SELECT reg FROM actuals)),
l AS (SELECT *, CASE WHEN usage = 'Passenger' THEN usage WHEN usage LIKE '%Cargo%' OR usage LIKE '%Freight%' THEN 'Freight / Cargo' WHEN usage IS NOT NULL THEN 'Other' END AS label FROM u)
SELECT count(*) AS tails, count(usage) AS labelled, count(*) FILTER (label <> 'Other') AS checked, count(*) FILTER (label = rule) AS correct, count(*) FILTER (label = 'Freight / Cargo') AS freighters,
       count(*) FILTER (label = 'Freight / Cargo' AND rule = label) AS freighters_found, count(*) FILTER (label IS NULL AND rule = 'Passenger') AS null_passenger,
       count(*) FILTER (label IS NULL AND rule <> 'Passenger') AS null_freight FROM l""",
}
