"""Queries of the research operators, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research as R
from ..session import stored
from .adaptors import ACTIVITY_SQL, AS_OF, SNAPSHOTS_SQL, activity, snapshots
from .panel_queries import rounded

CUT, SINCE = dt.date(2000, 6, 1), dt.date(1997, 1, 1)


FLOWN, ROUTE, PRICE = ("operator", "master_series", "reg", "date", "mon", "seats", "hours", "km"), ("origin", "dest"), ("price",)


def _flights(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The activity's columns FLOWN and more, stored: its lines meet their orders once a query, however often that reads
    them."""
    return stored(activity(spark, d).select(*FLOWN, *more))


def _panel(flights: DataFrame) -> DataFrame:
    return stored(R.anchor_panel(flights))


def _deliveries(flights: DataFrame) -> DataFrame:
    rows = flights.select(F.col("operator").alias("carrier"), F.col("master_series").alias("sf"), "reg", F.date_add(F.lit("2000-01-01").cast("date"), ((F.col("reg") * 37) % 700).cast("int")).alias("delivery_date"))
    return R.forward_deliveries(rows, CUT)


def _backtest(flights: DataFrame, panel: DataFrame) -> DataFrame:
    return R.backtest(panel, CUT, stored(_deliveries(flights)))


def anchor_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_panel(_flights(spark, d)), 4)


def plateau(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.plateau(_panel(_flights(spark, d))))


def forward_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(activity(spark, d))


def candidate_carriers(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(activity(spark, d), CUT, SINCE, 4)


def subfleet_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.subfleet_fit(_panel(_flights(spark, d)).where(F.col("mon") <= F.lit(CUT)), ["carrier", "sf"])[1])


def backtest(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d)
    return rounded(_backtest(flights, _panel(flights)), 5)


def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d)
    p = _panel(flights)
    return rounded(R.backtest_metrics(_backtest(flights, p), p, CUT), 5)


def forward_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.forward(_panel(_flights(spark, d)), CUT, AS_OF), 4)


def forward_damped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.forward(_panel(_flights(spark, d)), CUT, AS_OF, phi=0.9), 4)


def growth_read(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d)
    p = _panel(flights)
    return rounded(R.growth_read(R.backtest_metrics(_backtest(flights, p), p, CUT)), 5)


def loco_prior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.seasonal_prior(*R.subfleet_fit(_panel(_flights(spark, d)).where(F.col("mon") <= F.lit(CUT)), ["carrier", "sf"])))


def loco(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.loco(_panel(_flights(spark, d)), CUT), 5)


def loco_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.reliability(R.loco(_panel(_flights(spark, d)), CUT)))


def loco_carriers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.carrier_reliability(R.loco(_panel(_flights(spark, d)), CUT)), 5)


def _buckets(flights: DataFrame) -> DataFrame:
    return R.archetype(stored(R.archetype_features(flights, 100, 12)))


def ondemand_reliability(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d, *ROUTE)
    return rounded(R.ondemand_reliability(_panel(flights), stored(_buckets(flights)), CUT), 5)


def archetype_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.archetype_features(_flights(spark, d, *ROUTE), 100, 12))


def archetype_bucket(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_buckets(_flights(spark, d, *ROUTE)))


def _series(spark: SparkSession, d: str, flights: DataFrame) -> DataFrame:
    return stored(R.monthly_series(snapshots(spark, d, flights), flights, dt.date(1990, 1, 1)))


def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d, *PRICE)
    return R.monthly_series(snapshots(spark, d, flights), flights, SINCE)


def exog_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.recent_level(_series(spark, d, _flights(spark, d, *PRICE)), CUT))


def exog_evaluate(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d, *PRICE)
    return rounded(R.evaluate_recent(_series(spark, d, flights), _backtest(flights, _panel(flights)), CUT, 0.8, 0.6), 5)


def _settings(spark: SparkSession, d: str) -> DataFrame:
    flights = _flights(spark, d, *ROUTE, *PRICE)
    p = _panel(flights)
    detail = stored(_backtest(flights, p))
    return R.evaluate_settings(_series(spark, d, flights), detail, R.backtest_metrics(detail, p, CUT), stored(_buckets(flights)), CUT)


def exog_settings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_settings(spark, d), 5)


def exog_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.settings_summary(_settings(spark, d)), 5)


def metric_conversion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.convert_metrics(_panel(_flights(spark, d)), CUT), 3)


def conversion_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.conversion_errors(R.convert_metrics(_panel(_flights(spark, d)), CUT)), 5)


QUERIES = {
    f.__name__: f
    for f in (
        anchor_panel, plateau, forward_deliveries, candidate_carriers, subfleet_fit, backtest, backtest_metrics, growth_read, loco_prior, loco,
        loco_reliability, archetype_features, archetype_bucket, exog_forecast, exog_evaluate, metric_conversion, forward_forecast, forward_damped,
        loco_carriers, ondemand_reliability, monthly_series, exog_settings, exog_summary, conversion_errors,
    )
}


def seasonal_sql(name: str, source: str, keys: str, value: str) -> str:
    on = " AND ".join(f"b.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_per AS (SELECT {keys}, month(mon) AS cal, median({value}) AS med, count(*) AS n FROM {source} GROUP BY ALL),
{name}_base AS (SELECT {keys}, avg(med) AS base FROM {name}_per GROUP BY ALL),
{name}_seas AS (SELECT b.*, c.cal, CASE WHEN n IS NULL THEN 1.0 ELSE greatest(n / (n + 6.0) * med / base + 1 - n / (n + 6.0), 0.10) END AS seas, coalesce(n, 0) AS n
  FROM {name}_base b CROSS JOIN (SELECT unnest(range(1, 13)) AS cal) c LEFT JOIN {name}_per p ON {on} AND p.cal = c.cal)"""


def fit_sql(name: str, source: str, keys: str) -> str:
    return f"""{seasonal_sql(name, source, keys, "cycles")},
{name}_d AS (SELECT p.*, cycles / seas AS des, row_number() OVER (PARTITION BY {", ".join(f"p.{k.strip()}" for k in keys.split(","))} ORDER BY mon DESC) AS k FROM {source} p JOIN {name}_seas b ON {" AND ".join(f"b.{k.strip()} = p.{k.strip()}" for k in keys.split(","))} AND cal = month(mon)),
{name}_level AS (SELECT {keys}, median(des) FILTER (WHERE k <= 3) AS level, CASE WHEN count(*) >= 6 THEN (median(des) FILTER (WHERE k <= 3) - median(des) FILTER (WHERE k BETWEEN 4 AND 6)) / 3.0 ELSE 0.0 END AS slope, count(*) AS months,
  avg(sum_km / cycles) FILTER (WHERE sum_km <> 0) AS km_per_flight, median(seats_med) AS seats, CAST(median(flown) FILTER (WHERE k <= 3) AS DOUBLE) AS base_fleet, max(mon) AS as_of FROM {name}_d GROUP BY ALL)"""


PANEL_SQL = (
    ACTIVITY_SQL
    + """,
panel AS (SELECT operator AS carrier, master_series AS sf, mon, count(DISTINCT reg) AS flown, count(DISTINCT (reg, date)) AS tail_days, count(*) AS cycles, sum(hours) AS block_hours, sum(km) AS sum_km, median(km) AS med_haul, CAST(median(seats) AS DOUBLE) AS seats_med,
  count(DISTINCT (reg, date)) / count(DISTINCT reg) AS days_per_tail, count(*) / count(DISTINCT (reg, date)) AS cycles_per_day, sum(hours) / count(DISTINCT (reg, date)) AS hours_per_day FROM activity GROUP BY ALL),
deliveries AS (SELECT carrier, sf, CAST(date_trunc('month', dd) AS DATE) AS deliv, count(DISTINCT reg) AS n FROM (SELECT operator AS carrier, master_series AS sf, reg, CAST(DATE '2000-01-01' + CAST((reg * 37) % 700 AS INTEGER) AS DATE) AS dd FROM activity) WHERE dd > DATE '2000-06-01' GROUP BY ALL),
train AS (SELECT * FROM panel WHERE mon <= DATE '2000-06-01'),
actual AS (SELECT carrier, mon, CAST(sum(cycles) AS BIGINT) AS actual, CAST(sum(flown) AS BIGINT) AS flown FROM panel GROUP BY ALL),
gate AS (SELECT a.*, coalesce(actual >= least_, true) AS valid FROM actual a LEFT JOIN (SELECT carrier, median(actual) * 0.5 AS least_ FROM actual WHERE mon <= DATE '2000-06-01' GROUP BY carrier) USING (carrier) WHERE mon > DATE '2000-06-01'),
loo AS (SELECT t.*, h.held FROM train t JOIN (SELECT DISTINCT carrier, mon AS held FROM train) h ON h.carrier = t.carrier AND h.held <> t.mon)"""
)
BASE = f"{PANEL_SQL}, {fit_sql('f', 'train', 'carrier, sf')}, {fit_sql('x', 'loo', 'carrier, sf, held')}"
HORIZON = "greatest(1, year(mon) * 12 + month(mon) - 24006)"
BACKTEST_SQL = f"""{BASE},
growth AS (SELECT p.carrier, p.sf, p.mon, coalesce(least((base_fleet + (SELECT sum(n) FROM deliveries d WHERE d.carrier = p.carrier AND d.sf = p.sf AND d.deliv <= p.mon)) / base_fleet, 4.0), 1.0) AS g FROM panel p LEFT JOIN f_level l ON l.carrier = p.carrier AND l.sf = p.sf),
hats AS (SELECT g.carrier, g.mon, sum(greatest(level, 0.0) * seas * g) AS hat FROM growth g JOIN f_level l ON l.carrier = g.carrier AND l.sf = g.sf JOIN f_seas s ON s.carrier = g.carrier AND s.sf = g.sf AND s.cal = month(g.mon) GROUP BY ALL),
outs AS (SELECT g.carrier, g.mon, sum(greatest(level, 0.0) * seas * g) AS hat FROM growth g JOIN x_level l ON l.carrier = g.carrier AND l.sf = g.sf AND l.held = g.mon JOIN x_seas s ON s.carrier = g.carrier AND s.sf = g.sf AND s.held = g.mon AND s.cal = month(g.mon) GROUP BY ALL),
stats AS (SELECT carrier, CASE WHEN count(*) >= 2 THEN avg(ln(actual / hat)) ELSE 0.0 END AS mu, CASE WHEN count(*) >= 2 THEN greatest(stddev_pop(ln(actual / hat)), 0.05) ELSE 0.20 END AS sigma FROM outs JOIN actual USING (carrier, mon) GROUP BY carrier),
bt AS (SELECT g.carrier, g.mon, actual, flown, hat, (hat - actual) / actual * 100 AS err, hat * exp(mu - 1.2815515594 * sigma * sqrt({HORIZON})) AS lo, hat * exp(mu + 1.2815515594 * sigma * sqrt({HORIZON})) AS hi, valid FROM gate g JOIN hats USING (carrier, mon) JOIN stats USING (carrier)),
metrics AS (SELECT b.carrier, avg(abs(err)) FILTER (WHERE valid) AS mape, avg(err) FILTER (WHERE valid) AS bias, avg(CAST(actual BETWEEN lo AND hi AS INT)) FILTER (WHERE valid) AS coverage, count(*) FILTER (WHERE valid) AS n_holdout, count(*) FILTER (WHERE NOT valid) AS n_excluded,
  avg(flown) FILTER (WHERE valid) / (SELECT avg(flown) FROM (SELECT flown FROM actual a WHERE a.carrier = b.carrier AND mon <= DATE '2000-06-01' ORDER BY mon DESC LIMIT 12)) AS n_growth, count(*) FILTER (WHERE valid) >= 3 AS validatable FROM bt b GROUP BY b.carrier)"""
PRIOR = "prior AS (SELECT r.carrier, r.sf, r.cal, (ws - months * seas) / (w - months) AS prior FROM (SELECT s.carrier, s.sf, s.cal, s.seas, l.months, sum(l.months) OVER (PARTITION BY s.sf, s.cal) AS w, sum(l.months * s.seas) OVER (PARTITION BY s.sf, s.cal) AS ws FROM f_seas s JOIN f_level l ON l.carrier = s.carrier AND l.sf = s.sf) r WHERE w - months > 0)"
SHRUNK = "SELECT {k}, s.cal, level, CASE WHEN prior IS NOT NULL THEN months / (months + 6.0) * seas + (1 - months / (months + 6.0)) * prior ELSE seas END AS seas FROM {n}_seas s JOIN {n}_level l ON l.carrier = s.carrier AND l.sf = s.sf {h} LEFT JOIN prior p ON p.carrier = s.carrier AND p.sf = s.sf AND p.cal = s.cal"
LOCO_SQL = f"""{BASE}, {PRIOR},
own AS ({SHRUNK.format(k="s.carrier, s.sf", n="f", h="")}),
each AS ({SHRUNK.format(k="s.carrier, s.sf, s.held", n="x", h="AND l.held = s.held")}),
hats AS (SELECT p.carrier, p.mon, sum(greatest(level, 0.0) * seas) AS hat FROM panel p JOIN own o ON o.carrier = p.carrier AND o.sf = p.sf AND o.cal = month(p.mon) GROUP BY ALL),
outs AS (SELECT p.carrier, p.mon, sum(greatest(level, 0.0) * seas) AS hat FROM train p JOIN each o ON o.carrier = p.carrier AND o.sf = p.sf AND o.held = p.mon AND o.cal = month(p.mon) GROUP BY ALL),
stats AS (SELECT carrier, avg(ln(actual / hat)) AS mu, greatest(stddev_pop(ln(actual / hat)), 0.05) AS sigma FROM outs JOIN actual USING (carrier, mon) GROUP BY carrier),
lc AS (SELECT carrier, mon, actual, hat, (hat - actual) / actual * 100 AS err, abs(ln(actual / hat) - mu) / (sigma * sqrt({HORIZON})) AS z FROM gate JOIN hats USING (carrier, mon) JOIN stats USING (carrier) WHERE valid)"""
FEATURES = """routes AS (SELECT operator, origin, dest, count(*) AS f FROM activity GROUP BY ALL),
top AS (SELECT operator, count(*) AS pairs, sum(f) FILTER (WHERE k <= 10) AS top10 FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY f DESC, origin, dest) AS k FROM routes) GROUP BY operator),
features AS (SELECT operator AS carrier, tails, flights / pairs AS per_pair, top10 / flights AS top10_share, flights / (tails * months) AS per_tail_month
  FROM (SELECT operator, count(*) AS flights, count(DISTINCT mon) AS months, count(DISTINCT reg) AS tails FROM activity GROUP BY operator) JOIN top USING (operator) WHERE flights >= 100 AND months >= 12)"""
RECENT = f"""series AS (SELECT carrier, mon, CAST(sum(cycles) AS BIGINT) AS flights FROM panel WHERE mon <= DATE '2000-06-01' GROUP BY ALL), {seasonal_sql("e", "series", "carrier", "flights")},
er AS (SELECT s.carrier, flights, flights / seas AS des, year(mon) * 12 + month(mon) AS i, ln(greatest(flights / seas, 0.5)) AS l, row_number() OVER (PARTITION BY s.carrier ORDER BY mon DESC) AS k FROM series s JOIN e_seas e ON e.carrier = s.carrier AND e.cal = month(mon)),
en AS (SELECT *, (24006 - i <= 6 AND k <= 3) OR (k = 1 AND NOT bool_or(24006 - i <= 6 AND k <= 3) OVER (PARTITION BY carrier)) AS near, abs(l - median(l) OVER (PARTITION BY carrier)) AS d FROM er),
recent AS (SELECT carrier, CAST(median(flights) FILTER (WHERE near) AS DOUBLE) AS flat_level, median(des) FILTER (WHERE near) AS recent_level, max(i) - min(i) + 1 AS span, CASE WHEN count(*) >= 3 THEN least(greatest(1.4826 * median(d), 0.30), 1.10) ELSE 0.30 END AS sigma FROM en GROUP BY carrier)"""
BUCKETS = f"""{FEATURES}, scored AS (SELECT carrier, tails, (ln(per_pair) - avg(ln(per_pair)) OVER ()) / stddev_pop(ln(per_pair)) OVER () + (top10_share - avg(top10_share) OVER ()) / stddev_pop(top10_share) OVER () + (ln(per_tail_month) - avg(ln(per_tail_month)) OVER ()) / stddev_pop(ln(per_tail_month)) OVER () AS score FROM features),
steps AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, lead(score) OVER (ORDER BY score) AS nxt, count(*) OVER () AS n FROM scored),
cutoff AS (SELECT (score + nxt) / 2 AS threshold FROM steps WHERE i >= greatest(1, floor(n * 0.15)) AND i < least(n - 1, floor(n * 0.7)) AND nxt IS NOT NULL ORDER BY nxt - score DESC, i LIMIT 1),
limit_ AS (SELECT coalesce((SELECT threshold FROM cutoff), 0.0) AS threshold),
buckets AS (SELECT carrier, tails, score, CASE WHEN score < threshold THEN 'ondemand' ELSE 'schedule' END AS bucket, CASE WHEN tails < 40 THEN 'small' ELSE 'large' END AS size FROM scored, limit_)"""
#: The panel of the carriers that fly on demand alone, with all that follows from it.
ONDEMAND_SQL = LOCO_SQL.replace("panel AS (SELECT operator", "all_panel AS (SELECT operator", 1).replace("\ndeliveries AS", f"\n{BUCKETS},\npanel AS (SELECT * FROM all_panel WHERE carrier IN (SELECT carrier FROM buckets WHERE bucket = 'ondemand')),\ndeliveries AS", 1)
SETTINGS_SQL = f"""{BACKTEST_SQL}, {BUCKETS}, {RECENT}, v AS (SELECT carrier, mon, actual, hat, row_number() OVER w AS h, first_value(hat) OVER w AS anchor FROM bt WHERE valid WINDOW w AS (PARTITION BY carrier ORDER BY mon)),
o AS (SELECT v.*, sigma, CASE WHEN span < 24 THEN flat_level ELSE recent_level * seas END AS own FROM v JOIN recent r ON r.carrier = v.carrier JOIN e_seas e ON e.carrier = v.carrier AND e.cal = month(mon)),
y AS (SELECT *, w0 * exp(-g * abs(ln(own / anchor))) * own + (1 - w0 * exp(-g * abs(ln(own / anchor)))) * hat AS yhat, 1.2815515594 * sigma * sqrt(h) AS width FROM o, (VALUES ('pure', 1.0, 0.0), ('gated', 0.8, 0.6)) c(setting, w0, g)),
set_ AS (SELECT setting, y.carrier, any_value(b.tails) AS tails, any_value(b.size) AS size, avg(abs(yhat - actual) / actual * 100) AS mape, any_value(m.mape) AS anchor_mape, avg(CAST(actual BETWEEN yhat * exp(-width) AND yhat * exp(width) AS INT)) AS cov80, bool_or(sigma > 0.60) AS low_confidence
  FROM y JOIN buckets b ON b.carrier = y.carrier AND bucket = 'ondemand' JOIN metrics m ON m.carrier = y.carrier AND validatable GROUP BY setting, y.carrier)"""


def forward_sql(phi: float) -> str:
    level = f"greatest(level + {f'slope * (1 - pow({phi}, greatest((year(mon) - year(as_of)) * 12 + month(mon) - month(as_of), 0))) / (1 - {phi})' if phi else '0.0'}, 0.0)"
    return f"""WITH {PANEL_SQL}, {fit_sql('f', 'train', 'carrier, sf')},
past AS (SELECT carrier, mon, sum({level} * seas) AS hat FROM (SELECT DISTINCT carrier, mon FROM train) m JOIN f_level l USING (carrier) JOIN f_seas s USING (carrier, sf) WHERE s.cal = month(mon) GROUP BY ALL),
stats AS (SELECT carrier, CASE WHEN count(*) >= 2 THEN avg(ln(actual / hat)) ELSE 0.0 END AS mu, CASE WHEN count(*) >= 2 THEN greatest(stddev_pop(ln(actual / hat)), 0.05) ELSE 0.20 END AS sigma FROM past JOIN actual USING (carrier, mon) WHERE hat > 0 AND actual > 0 GROUP BY carrier),
ahead AS (SELECT *, CAST(unnest(generate_series(TIMESTAMP '2000-07-01', TIMESTAMP '2003-06-01', INTERVAL 1 MONTH)) AS DATE) AS mon FROM f_level),
each AS (SELECT carrier, mon, {level} * seas AS f, coalesce(km_per_flight, 0.0) AS per, coalesce(seats, 0.0) AS seats FROM ahead JOIN f_seas s USING (carrier, sf) WHERE s.cal = month(mon)),
t AS (SELECT carrier, mon, sum(f) AS flights, sum(f * per) AS km, sum(f * (0.411 + per / 868.0)) AS hours, sum(f * seats * 0.8) AS pax FROM each GROUP BY ALL)
SELECT carrier, mon, round(flights, 4) AS flights, round(flights * exp(mu - 1.2815515594 * sigma * sqrt({HORIZON})), 4) AS lo, round(flights * exp(mu + 1.2815515594 * sigma * sqrt({HORIZON})), 4) AS hi, round(km, 4) AS km, round(hours, 4) AS hours, round(pax, 4) AS pax FROM t JOIN stats USING (carrier)"""


SQL = {
    "forward_forecast": forward_sql(0.0),
    "forward_damped": forward_sql(0.9),
    "loco_carriers": f"WITH {LOCO_SQL} SELECT carrier, count(*) AS months, round(avg(abs(err)), 5) AS mape, round(avg(err), 5) + 0.0 AS bias, round(avg(CAST(z <= 1.2816 AS INT)), 5) AS cov80 FROM lc GROUP BY carrier",
    "ondemand_reliability": f"""WITH {ONDEMAND_SQL}, c AS (SELECT carrier, avg(abs(err)) AS mape, avg(CAST(z <= 1.2816 AS INT)) AS cov80 FROM lc GROUP BY carrier)
SELECT size, count(*) AS carriers, round(median(mape), 5) AS mape, round(median(cov80), 5) AS cov80 FROM c JOIN buckets USING (carrier) GROUP BY size""",
    "monthly_series": f"""WITH {SNAPSHOTS_SQL}, i AS (SELECT operator AS carrier, period AS mon, count(*) AS in_service FROM (SELECT *, row_number() OVER (PARTITION BY operator, reg, period ORDER BY revision_id DESC, id DESC) AS k FROM snapshots) WHERE k = 1 AND status = 'In Service' AND period >= DATE '1997-01-01' GROUP BY ALL),
f AS (SELECT operator AS carrier, mon, count(*) AS flights FROM activity WHERE mon >= DATE '1997-01-01' GROUP BY ALL) SELECT carrier, mon, in_service, flights FROM i FULL JOIN f USING (carrier, mon)""",
    "exog_settings": f"WITH {SETTINGS_SQL} SELECT setting, carrier, tails, size, round(mape, 5) AS mape, round(anchor_mape, 5) AS anchor_mape, round(cov80, 5) AS cov80, low_confidence FROM set_",
    "exog_summary": f"""WITH {SETTINGS_SQL} SELECT setting, count(*) AS carriers, count(*) FILTER (WHERE mape < anchor_mape) AS beats, round(median(mape) FILTER (WHERE size = 'small'), 5) AS mape,
  round(median(anchor_mape) FILTER (WHERE size = 'small'), 5) AS anchor_mape, round(avg(cov80) FILTER (WHERE size = 'small'), 5) AS cov80 FROM set_ GROUP BY setting""",
    "anchor_panel": f"WITH {PANEL_SQL} SELECT carrier, sf, mon, flown, tail_days, cycles, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("block_hours", "sum_km", "med_haul", "seats_med", "days_per_tail", "cycles_per_day", "hours_per_day")) + " FROM panel",
    "plateau": f"WITH {PANEL_SQL} SELECT carrier, sf, round(avg(cycles), 6) AS cycles, round(avg(flown), 6) AS flown, round(avg(med_haul), 6) AS haul, round(avg(cycles_per_day), 6) AS cycles_per_day, round(avg(hours_per_day), 6) AS hours_per_day, CASE WHEN avg(med_haul) < 2500 THEN 'short' ELSE 'long' END AS leg FROM (SELECT *, row_number() OVER (PARTITION BY carrier, sf ORDER BY mon DESC) AS k FROM panel) WHERE k <= 12 GROUP BY carrier, sf",
    "forward_deliveries": f"WITH {PANEL_SQL} SELECT * FROM deliveries",
    "candidate_carriers": f"WITH {ACTIVITY_SQL} SELECT operator AS carrier, count(*) AS flights, count(DISTINCT mon) AS months, count(DISTINCT mon) FILTER (WHERE mon > DATE '2000-06-01') AS held_out FROM activity WHERE mon >= DATE '1997-01-01' GROUP BY operator HAVING count(DISTINCT mon) >= 24 AND count(DISTINCT mon) FILTER (WHERE mon > DATE '2000-06-01') >= 4 ORDER BY flights DESC, carrier LIMIT 4",
    "subfleet_fit": f"WITH {PANEL_SQL}, {fit_sql('f', 'train', 'carrier, sf')} SELECT carrier, sf, months, as_of, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("level", "slope", "km_per_flight", "seats", "base_fleet")) + " FROM f_level",
    "backtest": f"WITH {BACKTEST_SQL} SELECT carrier, mon, actual, flown, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("hat", "err", "lo", "hi")) + ", actual BETWEEN lo AND hi AS inside, valid FROM bt",
    "backtest_metrics": f"WITH {BACKTEST_SQL} SELECT carrier, n_holdout, n_excluded, validatable, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("mape", "bias", "coverage", "n_growth")) + " FROM metrics",
    "growth_read": f"""WITH {BACKTEST_SQL}, v AS (SELECT *, CASE WHEN n_growth > 1.05 THEN 'grew' WHEN n_growth >= 0.95 THEN 'stable' ELSE 'shrank' END AS g FROM metrics WHERE validatable AND n_growth IS NOT NULL)
SELECT count(*) AS carriers, CASE WHEN count(*) >= 3 AND stddev_pop(n_growth) * stddev_pop(bias) > 0 THEN round(corr(n_growth, bias), 5) + 0.0 END AS r,
       """
    + ",\n       ".join(f"count(*) FILTER (g = '{g}') AS {g}, " + ", ".join(f"round(avg({m}) FILTER (g = '{g}'), 5) + 0.0 AS {g}_{m}" for m in ("bias", "mape", "coverage")) for g in ("grew", "stable", "shrank"))
    + " FROM v",
    "loco_prior": f"WITH {PANEL_SQL}, {fit_sql('f', 'train', 'carrier, sf')}, {PRIOR} SELECT carrier, sf, cal, round(prior, 6) AS prior FROM prior",
    "loco": f"WITH {LOCO_SQL} SELECT carrier, mon, actual, round(hat, 5) AS hat, round(err, 5) + 0.0 AS err, z <= 0.6745 AS in50, z <= 1.2816 AS in80, z <= 1.6449 AS in90 FROM lc",
    "loco_reliability": f"WITH {LOCO_SQL} SELECT n AS nominal, round(avg(CAST(z <= q AS INT)), 6) AS empirical, count(*) AS months FROM lc, (VALUES (50, 0.6745), (80, 1.2816), (90, 1.6449)) v(n, q) GROUP BY n",
    "archetype_features": f"WITH {ACTIVITY_SQL}, {FEATURES} SELECT carrier, tails, round(per_pair, 6) AS per_pair, round(top10_share, 6) AS top10_share, round(per_tail_month, 6) AS per_tail_month FROM features",
    "archetype_bucket": f"WITH {ACTIVITY_SQL}, {BUCKETS} SELECT carrier, tails, round(score, 6) + 0.0 AS score, bucket, size FROM buckets",
    "exog_forecast": f"WITH {PANEL_SQL}, {RECENT} SELECT carrier, round(flat_level, 6) AS flat_level, round(recent_level, 6) AS recent_level, span, round(sigma, 6) AS sigma, sigma > 0.60 AS low_confidence FROM recent",
    "exog_evaluate": f"""WITH {BACKTEST_SQL}, {RECENT}, v AS (SELECT carrier, mon, actual, hat, row_number() OVER w AS h, first_value(hat) OVER w AS anchor FROM bt WHERE valid WINDOW w AS (PARTITION BY carrier ORDER BY mon)),
o AS (SELECT v.*, sigma, CASE WHEN span < 24 THEN flat_level ELSE recent_level * seas END AS own FROM v JOIN recent r ON r.carrier = v.carrier JOIN e_seas e ON e.carrier = v.carrier AND e.cal = month(mon)),
y AS (SELECT *, 0.8 * exp(-0.6 * abs(ln(own / anchor))) * own + (1 - 0.8 * exp(-0.6 * abs(ln(own / anchor)))) * hat AS yhat, 1.2815515594 * sigma * sqrt(h) AS width FROM o)
SELECT carrier, mon, actual, round(yhat, 5) AS yhat, round(yhat * exp(-width), 5) AS lo, round(yhat * exp(width), 5) AS hi, sigma > 0.60 AS low_confidence FROM y""",
    "metric_conversion": f"""WITH {PANEL_SQL}, {fit_sql('f', 'train', 'carrier, sf')}, per AS (SELECT carrier, sf, month(mon) AS cal, avg(sum_km / cycles) AS s, count(*) AS n FROM train WHERE sum_km <> 0 GROUP BY ALL),
c AS (SELECT p.carrier, p.mon, greatest(level, 0.0) * seas AS f, coalesce(km_per_flight, 0.0) AS flat, coalesce(r.n / (r.n + 4.0) * r.s + (1 - r.n / (r.n + 4.0)) * km_per_flight, km_per_flight, 0.0) AS km, coalesce(seats, 0.0) AS seats
  FROM panel p JOIN f_level l ON l.carrier = p.carrier AND l.sf = p.sf JOIN f_seas s ON s.carrier = p.carrier AND s.sf = p.sf AND s.cal = month(p.mon) LEFT JOIN per r ON r.carrier = p.carrier AND r.sf = p.sf AND r.cal = month(p.mon)),
t AS (SELECT carrier, mon, sum(f) AS flights_hat, sum(f * km) AS km_hat, sum(f * flat) AS km_hat_flat, sum(f * (0.411 + km / 868.0)) AS hours_hat, sum(f * seats * 0.8) AS pax_hat FROM c GROUP BY ALL)
SELECT g.carrier, g.mon, round(flights_hat, 3) AS flights_hat, round(km_hat, 3) AS km_hat, round(km_hat_flat, 3) AS km_hat_flat, round(hours_hat, 3) AS hours_hat, round(pax_hat, 3) AS pax_hat, actual AS flights_actual, round(k.km, 3) AS km_actual
FROM gate g JOIN t USING (carrier, mon) JOIN (SELECT carrier, mon, sum(sum_km) AS km FROM panel GROUP BY ALL) k USING (carrier, mon) WHERE valid""",
}
SQL["conversion_errors"] = (
    SQL["metric_conversion"].split("\nSELECT g.carrier")[0]
    + """
SELECT g.carrier, count(*) AS months, round(avg(abs(flights_hat - actual) / actual * 100), 5) AS flights_mape, round(avg(CASE WHEN k.km <> 0 THEN abs(km_hat - k.km) / k.km * 100 END), 5) AS km_mape,
  round(avg(CASE WHEN k.km <> 0 THEN abs(km_hat_flat - k.km) / k.km * 100 END), 5) AS km_mape_flat
FROM gate g JOIN t USING (carrier, mon) JOIN (SELECT carrier, mon, sum(sum_km) AS km FROM panel GROUP BY ALL) k USING (carrier, mon) WHERE valid GROUP BY g.carrier"""
)
