"""Queries of the interval, position and source operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as V
from ..operators import positions as Q
from ..sources import readers as S
from .adaptors import POSITIONS_SQL, geo, positions, table
from .panel_queries import rounded



def _now():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


def _days(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Days with an event, or with one of a kind: purchases stand for what a ledger has, clicks for what was seen since."""
    events = table(spark, d, "events")
    events = events.where(F.col("event_type") == kind) if kind else events
    return events.select(F.col("user_id").alias("reg"), F.to_date("ts").alias("date")).distinct()


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    days = _days(spark, d, "purchase")
    return V.coalesce_intervals(days.select("reg", F.col("date").alias("from_date"), F.col("date").alias("to_date")), 1)


def _cut():
    return F.lit("2024-01-27").cast("date")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    windows = _days(spark, d).select("reg").distinct().select("reg", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("reg") % 5).cast("int")).alias("start"), F.lit("2024-01-31").cast("date").alias("stop"))
    return V.complement(coverage_coalesce(spark, d), windows)


def coverage_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return V.fold(_ledger(spark, d), _days(spark, d, "click"), _cut(), 2)


def coverage_complement(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


def coverage_segments(spark: SparkSession, d: str) -> DataFrame:
    return V.segment_groups(_gaps(spark, d)).select("from_date", "to_date", F.array_join("regs", ",").alias("regs"))


def coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    return V.plan_requests(V.segment_groups(_gaps(spark, d)))


def coverage_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The requests themselves: at most five days for at most four aircraft."""
    return V.chunk_ranges(V.segment_groups(_gaps(spark, d)), 5, 4).select("from_date", "to_date", F.array_join("regs", ",").alias("regs"))


def coverage_advance(spark: SparkSession, d: str) -> DataFrame:
    return V.advance_ledger(_ledger(spark, d), _gaps(spark, d), _days(spark, d), _cut())


def positions_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.running_distance(positions(spark, d), geo(spark, d))
    return rows.select("fr24_id", "timestamp", (F.round("distance", 2) + F.lit(0.0)).alias("distance"), F.round("time_delta", 6).alias("time_delta"))


def current_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.current_positions(positions(spark, d), _now()).select("reg", "timestamp", "lat", "lon", "is_grounded"))


def current_flow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.current_flow(positions(spark, d), _now()).select("reg", "fr24_id", "timestamp", "alt", "is_grounded"))


def aircraft_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("reg"), "event_type", F.col("ts").cast("timestamp").alias("last_update"))
    rows = e.select("reg", F.col("event_type").alias("operator"), F.lit("en-route").alias("status"), "last_update")
    batch = rows.where("last_update >= '2024-01-30' AND operator <> 'error'")
    known = rows.where("last_update >= '2024-01-27' AND operator = 'purchase'").select("reg")
    unheard = table(spark, d, "customer").where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10000000).alias("reg"))
    return Q.aircraft_state(rows.where("last_update < '2024-01-30'"), batch, known.unionByName(unheard), F.lit("2024-02-01").cast("timestamp"))


def schedule_flatten(spark: SparkSession, d: str) -> DataFrame:
    """All columns of schedules whose objects and fields are there or not, as orders have it."""
    o, key, who = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    at = lambda k: F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 24 * 3600), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = lambda letter, k: F.concat(F.lit(letter), k)

    def stop(letter: str, k: Column) -> Column:
        return F.struct(
            text(letter, k % 40).alias("iataCode"), F.when(k % 3 != 0, text(f"K{letter}", k % 40)).alias("icaoCode"), text("T", k % 4).alias("terminal"), F.when(k % 5 != 0, text("G", k % 9)).alias("gate"),
            text("belt ", k % 5).alias("baggage"), (k % 90).cast("int").alias("delay"), at(F.lit(0)).alias("scheduledTime"), at(k).alias("estimatedTime"), F.when(k % 2 == 0, at(k + 1)).alias("actualTime"),
            F.when(k % 7 == 0, at(k + 2)).alias("estimatedRunway"), at(k + 3).alias("actualRunway"),
        )

    def carrier(letter: str, k: Column) -> tuple[Column, Column]:
        airline = F.struct(text(f"{letter} line ", k % 11).alias("name"), text(letter, k % 7).alias("iataCode"), F.when(k % 4 != 0, text(f"{letter}C", k % 7)).alias("icaoCode"))
        return airline.alias("airline"), F.struct(k.cast("string").alias("number"), text(letter, k).alias("iataNumber"), F.when(k % 4 != 0, text(f"{letter}C", k)).alias("icaoNumber")).alias("flight")

    arrival, shared = F.when(key % 6 != 0, stop("B", who)).alias("arrival"), F.when(key % 4 == 0, F.struct(*carrier("Q", who))).alias("codeshared")
    doc = F.to_json(F.struct(F.lit("departure").alias("type"), F.col("o_orderstatus").alias("status"), stop("A", key).alias("departure"), arrival, *carrier("L", key), shared))
    return S.flatten_schedules(o.select(doc.alias("json")))


def airport_best(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    code = F.concat(F.lit("A"), F.chr(65 + key % 7), F.chr(65 + key % 5))
    airports = s.select(key.alias("id"), F.concat(F.lit("I"), key).alias("ident"), F.element_at(F.array(*[F.lit(t) for t in ("closed", "small_airport", "large_airport", "heliport")]), (key % 4 + 1).cast("int")).alias("type"), F.col("s_nationkey").cast("string").alias("iso_country"), F.when(key % 3 == 0, "yes").otherwise("no").alias("scheduled_service"), F.when(key % 4 == 1, "").otherwise(code).alias("iata_code"), F.when(key % 8 == 1, F.concat(F.lit("old name, "), code)).alias("keywords"))
    countries = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    strips = s.select(F.concat(F.lit("I"), key % 60).alias("airport_ident"), F.when(key % 5 == 0, "1").otherwise("0").alias("closed"), F.concat(F.lit("L"), key % 36).alias("le_ident"), F.lit("R").alias("he_ident"), (key * 10).alias("length_ft"), F.lit(100).alias("width_ft"), F.lit("ASP").alias("surface"))
    return S.build_airports(airports, countries, strips).select("id", "iata", "country", "from_keyword", F.coalesce(F.size("runways"), F.lit(0)).alias("n_runways"))


def airport_reference(spark: SparkSession, d: str) -> DataFrame:
    """The airport table of source files that are made of suppliers: codes with blanks, odd numbers, codes in keywords."""
    key, text = F.col("s_suppkey"), lambda c: c.cast("string")
    letters = lambda *k: F.concat(*[F.chr(65 + x) for x in k])
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    s = table(spark, d, "supplier")
    airports = s.select(
        text(key).alias("id"), F.when(key % 3 == 0, letters(key % 26, key % 25, key % 24, key % 23)).otherwise(F.concat(F.lit("i-"), key)).alias("ident"), pick(("closed", "small_airport", "large_airport", "odd"), key).alias("type"),
        F.when(key % 6 != 0, F.col("s_name")).otherwise("").alias("name"), F.when(key % 5 == 0, "x").otherwise(text(key / 10)).alias("latitude_deg"), text(key / -20).alias("longitude_deg"), F.when(key % 7 != 0, text(key * 3)).alias("elevation_ft"),
        pick(("AF", "NA", "XX", ""), key).alias("continent"), text(F.col("s_nationkey")).alias("iso_country"), F.lit("").alias("iso_region"), F.concat(F.lit("city "), key).alias("municipality"), pick(("yes", "no"), key).alias("scheduled_service"),
        F.when(key % 4 == 0, F.concat(F.lit(" K"), letters(key % 11, key % 12, key % 13))).otherwise(" ").alias("icao_code"), F.when(key % 2 == 0, F.concat(F.lit(" "), letters(key % 5, key % 6, key % 7))).otherwise("").alias("iata_code"),
        F.when(key % 8 == 1, F.concat(F.lit("old name, abc , "), letters(key % 9, key % 8, key % 7), F.lit(","), letters(key % 9, key % 8, key % 7, key % 6))).alias("keywords"),
    )
    countries = table(spark, d, "nation").select(text(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    strips = s.select(
        F.concat(F.lit("i-"), key % 60).alias("airport_ident"), F.when(key % 5 == 0, "1").otherwise("0").alias("closed"), F.concat(F.lit("L"), key % 36).alias("le_ident"), F.lit("").alias("he_ident"),
        F.when(key % 9 == 0, "long").otherwise(text(key * 10)).alias("length_ft"), F.lit("100").alias("width_ft"), F.lit("ASP").alias("surface"), text(key % 360).alias("le_heading_degT"), F.lit("").alias("he_heading_degT"),
    )
    out = S.airport_reference(airports, countries, strips)
    heading, longest = F.transform("runways", lambda r: r["le_heading"]), F.array_max(F.transform("runways", lambda r: r["length_ft"]))
    return rounded(out.withColumns({"headings": F.aggregate(heading, F.lit(0.0), lambda a, x: a + x), "longest_ft": longest, "open_runways": F.size("runways")}).withColumn("open_runways", F.when(F.col("runways").isNotNull(), F.col("open_runways"))).drop("runways"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_coalesce, coverage_complement, coverage_segments, coverage_plan, coverage_chunks, coverage_advance, positions_distance, current_positions,
        current_flow, aircraft_state, schedule_flatten, airport_best, airport_reference,
    )
}


def islands(name: str, source: str, gap: int) -> str:
    """A CTE that merges (reg, f, t) intervals."""
    return f"""{name} AS (SELECT reg, min(f) AS f, max(t) AS t FROM (SELECT *, sum(n) OVER (PARTITION BY reg ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN f - max(t) OVER (PARTITION BY reg ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS n FROM ({source}))) GROUP BY reg, i)"""


COVER = (
    "days AS (SELECT DISTINCT user_id AS reg, CAST(ts AS DATE) AS date FROM events),\n"
    + islands("ledger", "SELECT DISTINCT user_id AS reg, CAST(ts AS DATE) AS f, CAST(ts AS DATE) AS t FROM events WHERE event_type = 'purchase'", 1)
    + ",\n"
    + islands("seen", "SELECT DISTINCT user_id AS reg, CAST(ts AS DATE) AS f, CAST(ts AS DATE) AS t FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) <= DATE '2024-01-27'", 2)
    + ",\n"
    + islands("covered", "SELECT * FROM ledger UNION ALL SELECT * FROM seen", 1)
    # Gaps day by day: a day of the window that no interval covers; runs of days are the gaps.
    + """,
windows AS (SELECT DISTINCT reg, CAST(DATE '2024-01-01' + CAST(reg % 5 AS INTEGER) AS DATE) AS start FROM days),
open_days AS (SELECT reg, day FROM (SELECT reg, CAST(unnest(generate_series(start::TIMESTAMP, TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM windows) w WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.reg = w.reg AND w.day BETWEEN c.f AND c.t)),
gaps AS (SELECT reg, min(day) AS f, max(day) AS t FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY reg ORDER BY day) AS INTEGER) AS g FROM open_days) GROUP BY reg, g),
day_sets AS (SELECT day, string_agg(reg, ',' ORDER BY reg) AS regs, count(*) AS n FROM open_days GROUP BY day),
segments AS (SELECT min(day) AS from_date, max(day) AS to_date, regs, n FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY regs ORDER BY day) AS INTEGER) AS g FROM day_sets) GROUP BY regs, n, g)"""
)
_TOTAL = """, s AS (SELECT p.*, lag(p.lat) OVER w AS plat, lag(p.lon) OVER w AS plon, lag(timestamp) OVER w AS pts, g.lat AS olat, g.lon AS olon FROM positions p LEFT JOIN geo g ON p.origin = g.code WINDOW w AS (PARTITION BY fr24_id ORDER BY timestamp, p.lat NULLS FIRST, p.lon NULLS FIRST, gspeed, p.origin)),
h AS (SELECT *, pow(sin(radians(lat - coalesce(plat, olat)) / 2), 2) + cos(radians(coalesce(plat, olat))) * cos(radians(lat)) * pow(sin(radians(lon - coalesce(plon, olon)) / 2), 2) AS a, lat IS NOT NULL AND plat IS NULL AS seeds FROM s),
k AS (SELECT *, CASE WHEN lat IS NULL THEN 0.0 WHEN a IS NOT NULL THEN 2 * 6371.0 * atan2(sqrt(a), sqrt(greatest(0.0, 1 - a))) WHEN gspeed >= 120 THEN gspeed * 1.825 / 5 ELSE 0.0 END AS hop, sum(CAST(seeds AS INT)) OVER (PARTITION BY fr24_id ORDER BY timestamp, lat NULLS FIRST, lon NULLS FIRST, gspeed, origin ROWS UNBOUNDED PRECEDING) AS part FROM h)"""
_GROUNDED = "(alt < 500 AND gspeed < 50) OR epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(timestamp)) > 7200 OR (epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(timestamp)) > 1800 AND alt < 10000 AND vspeed < -256)"


def _stop_sql(end: str, letter: str, k: str, there: str) -> str:
    """The columns of a schedule's departure or arrival, null where it isn't there."""
    at = "o_orderdate + to_hours(CAST(({k}) % 24 AS INT))".replace("{k}", "{0}")
    fields = {
        "iata": f"'{letter}' || ({k} % 40)", "icao": f"CASE WHEN {k} % 3 <> 0 THEN 'K{letter}' || ({k} % 40) END", "terminal": f"'T' || ({k} % 4)", "gate": f"CASE WHEN {k} % 5 <> 0 THEN 'G' || ({k} % 9) END",
        "delay": f"CAST({k} % 90 AS INTEGER)", "scheduled": "o_orderdate", "estimated": at.format(k), "actual": f"CASE WHEN {k} % 2 = 0 THEN {at.format(k + ' + 1')} END",
        "estimated_runway": f"CASE WHEN {k} % 7 = 0 THEN {at.format(k + ' + 2')} END", "actual_runway": at.format(k + " + 3"),
    }
    fields |= {"baggage": f"'belt ' || ({k} % 5)"} if end == "arr" else {}
    return ", ".join(f"CASE WHEN {there} THEN {v} END AS {end}_{c}" for c, v in fields.items())


def _carrier_sql(prefix: str, letter: str, k: str, there: str) -> str:
    """The columns of an airline and its flight number, null where they aren't there."""
    fields = {
        "airline_name": f"'{letter} line ' || ({k} % 11)", "airline_iata": f"'{letter}' || ({k} % 7)", "airline_icao": f"CASE WHEN {k} % 4 <> 0 THEN '{letter}C' || ({k} % 7) END",
        "flight_number": f"CAST({k} AS VARCHAR)", "flight_iata": f"'{letter}' || {k}", "flight_icao": f"CASE WHEN {k} % 4 <> 0 THEN '{letter}C' || {k} END",
    }
    return ", ".join(f"CASE WHEN {there} THEN {v} END AS {prefix}{c}" for c, v in fields.items())


SQL = {
    "coverage_coalesce": f"WITH {COVER} SELECT reg, f AS from_date, t AS to_date FROM covered",
    "coverage_complement": f"WITH {COVER} SELECT reg, f AS from_date, t AS to_date FROM gaps",
    "coverage_segments": f"WITH {COVER} SELECT from_date, to_date, regs FROM segments",
    "coverage_plan": f"WITH {COVER} SELECT from_date, to_date, n AS aircraft, CAST(greatest(1, ceil((to_date - from_date + 1) / 14)) * ceil(n / 15) AS BIGINT) AS requests FROM segments",
    "coverage_chunks": f"""WITH {COVER}, l AS (SELECT *, string_split(regs, ',') AS r FROM segments),
d AS (SELECT *, CAST(unnest(generate_series(from_date::TIMESTAMP, to_date::TIMESTAMP, INTERVAL 5 DAY)) AS DATE) AS a FROM l),
k AS (SELECT *, unnest(range(0, len(r), 4)) AS k FROM d)
SELECT a AS from_date, least(CAST(a + 4 AS DATE), to_date) AS to_date, array_to_string(r[k + 1:k + 4], ',') AS regs FROM k""",
    "coverage_advance": f"""WITH {COVER}, u AS (SELECT g.reg, g.f, least(greatest((SELECT max(date) FROM days d WHERE d.reg = g.reg AND d.date BETWEEN g.f AND g.t), least(g.t, DATE '2024-01-27')), g.t) AS t FROM gaps g),
{islands("final", "SELECT * FROM ledger UNION ALL SELECT * FROM u WHERE t >= f", 1)} SELECT reg, f AS from_date, t AS to_date FROM final""",
    "positions_distance": f"WITH {POSITIONS_SQL}{_TOTAL} SELECT fr24_id, timestamp, round(sum(hop) OVER (PARTITION BY fr24_id, part ORDER BY timestamp, lat NULLS FIRST, lon NULLS FIRST, gspeed, origin ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS distance, round(greatest(0.0, coalesce((epoch_us(timestamp) - epoch_us(pts)) / 1e6, 0.0)), 6) AS time_delta FROM k",
    "current_positions": f"WITH {POSITIONS_SQL} SELECT reg, timestamp, lat, lon, {_GROUNDED} AS is_grounded FROM (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY timestamp DESC) AS k FROM positions) WHERE k = 1",
    "current_flow": f"WITH {POSITIONS_SQL} SELECT reg, fr24_id, timestamp, round(alt, 6) AS alt, {_GROUNDED} AS is_grounded FROM positions",
    "aircraft_state": """WITH r AS (SELECT user_id AS reg, event_type AS operator, ts AS last_update FROM events),
batch AS (SELECT * FROM r WHERE last_update >= TIMESTAMP '2024-01-30' AND operator <> 'error'),
state AS (SELECT reg, arg_max(operator, last_update) AS operator, max(last_update) AS last_update FROM (SELECT * FROM r WHERE last_update < TIMESTAMP '2024-01-30' UNION ALL SELECT * FROM batch) GROUP BY reg),
roster AS (SELECT reg FROM r WHERE last_update >= TIMESTAMP '2024-01-27' AND operator = 'purchase' UNION SELECT c_custkey + 10000000 FROM customer WHERE c_custkey % 50 = 0),
missing AS (SELECT reg FROM roster WHERE reg NOT IN (SELECT reg FROM batch))
SELECT reg, operator, CASE WHEN m.reg IS NOT NULL THEN 'landed' ELSE 'en-route' END AS status, CASE WHEN m.reg IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE last_update END AS last_update
FROM state FULL JOIN missing m USING (reg)""",
    "schedule_flatten": "SELECT 'departure' AS type, o_orderstatus AS status, "
    + ", ".join([_stop_sql("dep", "A", "o_orderkey", "TRUE"), _stop_sql("arr", "B", "o_custkey", "o_orderkey % 6 <> 0"), _carrier_sql("", "L", "o_orderkey", "TRUE"), _carrier_sql("codeshared_", "Q", "o_custkey", "o_orderkey % 4 = 0")])
    + " FROM orders",
    "airport_reference": """WITH a AS (SELECT s_suppkey AS k, s_name, s_nationkey FROM supplier),
b AS (SELECT *, CASE WHEN k % 3 = 0 THEN chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + k % 25 AS INT)) || chr(CAST(65 + k % 24 AS INT)) || chr(CAST(65 + k % 23 AS INT)) ELSE 'i-' || k END AS ident,
    ['closed', 'small_airport', 'large_airport', 'odd'][k % 4 + 1] AS type, CASE WHEN k % 8 = 1 THEN chr(CAST(65 + k % 9 AS INT)) || chr(CAST(65 + k % 8 AS INT)) || chr(CAST(65 + k % 7 AS INT)) END AS kw,
    CASE WHEN k % 2 = 0 THEN chr(CAST(65 + k % 5 AS INT)) || chr(CAST(65 + k % 6 AS INT)) || chr(CAST(65 + k % 7 AS INT)) END AS own FROM a),
c AS (SELECT *, coalesce(own, kw) AS iata, own IS NULL AND kw IS NOT NULL AS from_keyword,
    coalesce(CASE WHEN k % 4 = 0 THEN 'K' || chr(CAST(65 + k % 11 AS INT)) || chr(CAST(65 + k % 12 AS INT)) || chr(CAST(65 + k % 13 AS INT)) END, CASE WHEN k % 3 = 0 THEN ident END, kw || chr(CAST(65 + k % 6 AS INT))) AS icao FROM b),
d AS (SELECT * FROM c QUALIFY iata IS NULL OR row_number() OVER (PARTITION BY iata ORDER BY from_keyword, type = 'closed', CASE type WHEN 'large_airport' THEN 1 WHEN 'small_airport' THEN 3 WHEN 'closed' THEN 7 ELSE 8 END, k % 2 = 1, k) = 1),
r AS (SELECT 'i-' || (s_suppkey % 60) AS ident, count(*) AS n, sum(CAST(s_suppkey % 360 AS DOUBLE)) AS headings, max(CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 10 END) AS longest FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS id, iata, d.ident, icao, CASE WHEN k % 6 <> 0 THEN s_name END AS name, 'city ' || k AS city, n_name AS country, CAST(s_nationkey AS VARCHAR) AS iso_country, round(k / -20, 6) + 0.0 AS lon,
  CASE WHEN k % 5 <> 0 THEN round(k / 10, 6) END AS lat, type, CASE WHEN k % 7 <> 0 THEN CAST(k * 3 AS INTEGER) END AS elevation_ft, CAST(NULL AS VARCHAR) AS iso_region,
  ['Africa', 'North America', NULL, NULL][k % 4 + 1] AS continent, ['AF', 'NA', 'XX', NULL][k % 4 + 1] AS continent_code, from_keyword,
  CASE WHEN k % 8 = 1 THEN 'old name, abc , ' || kw || ',' || kw || chr(CAST(65 + k % 6 AS INT)) END AS keywords, headings, CAST(longest AS INTEGER) AS longest_ft, CAST(n AS INTEGER) AS open_runways
FROM d JOIN nation ON s_nationkey = n_nationkey LEFT JOIN r ON r.ident = d.ident""",
    "airport_best": """WITH a AS (SELECT s_suppkey AS id, s_nationkey, ['closed', 'small_airport', 'large_airport', 'heliport'][s_suppkey % 4 + 1] AS type, s_suppkey % 3 = 0 AS sched, 'A' || chr(CAST(65 + s_suppkey % 7 AS INT)) || chr(CAST(65 + s_suppkey % 5 AS INT)) AS code FROM supplier),
c AS (SELECT *, CASE WHEN id % 4 <> 1 OR id % 8 = 1 THEN code END AS iata, id % 8 = 1 AS kw FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY iata ORDER BY kw, type = 'closed', list_position(['large_airport', 'medium_airport', 'small_airport', 'seaplane_base', 'heliport', 'balloonport', 'closed'], type), NOT sched, id) AS k FROM c)
SELECT id, iata, n_name AS country, kw AS from_keyword, CAST((SELECT count(*) FROM supplier s WHERE s.s_suppkey % 60 = k.id AND s.s_suppkey % 5 <> 0) AS INTEGER) AS n_runways FROM k JOIN nation ON s_nationkey = n_nationkey WHERE k = 1 OR iata IS NULL""",
}
