"""The driver's tables as fleet-activity inputs. Each adaptor is written twice: here and, for the oracles, in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month, month_ordinal
from ..functions.scalars import great_circle
from ..session import stored

AS_OF = dt.date(2001, 6, 15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("code"), ((F.col("n_nationkey") * 37) % 140 - 70).cast("double").alias("lat"), ((F.col("n_nationkey") * 83) % 360 - 180).cast("double").alias("lon")
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per flight: lineitem as trips of suppliers' aircraft to customers' nations.

    Nations and regions, whose number is fixed, are joined last and broadcast; an order finds its customer's nation before
    it meets its lines. So the lines, by far the largest table, are dealt once, by their order, and suppliers and customers
    are broadcast as long as they are small."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dest"))
    ends = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dest")
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("operator"))
    places = geo(spark, sf_dir)
    a = places.select(*[F.col(c).alias(f"o_{c}") for c in ("code", "lat", "lon")]).join(table(spark, sf_dir, "nation"), F.col("o_code") == F.col("n_nationkey"))
    a, b = a.join(regions, F.col("n_regionkey") == F.col("r_regionkey")), places.select(*[F.col(c).alias(f"d_{c}") for c in ("code", "lat", "lon")])
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("origin"))
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(ends, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(F.broadcast(a), F.col("origin") == F.col("o_code")).join(F.broadcast(b), F.col("dest") == F.col("d_code"))
    date = F.to_date("l_shipdate")
    return rows.select(
        F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(date, "yyyy-MM-dd"), F.round(F.col("l_extendedprice") * 100).cast("long")).cast("binary")).alias("flight_id"),
        F.col("l_suppkey").alias("reg"), date.alias("date"), month(date).alias("mon"), "operator",
        "origin", "dest", (F.col("l_quantity") / 2).alias("hours"),
        F.when(F.col("origin") == F.col("dest"), F.lit(0.0)).otherwise(great_circle(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))).alias("km"),
        (F.col("l_extendedprice") / 1000).alias("price"), *_kind(F.col("l_suppkey")),
    ).select("flight_id", "reg", "date", "mon", "operator", "sub_series", "master_series", "origin", "dest", "seats", "hours", "km", "price")


def _kind(reg: Column) -> list[Column]:
    """What an aircraft's number tells of it: sub_series, master_series and seats."""
    return [F.concat(F.lit("S"), reg % 6).alias("sub_series"), F.concat(F.lit("M"), reg % 3).alias("master_series"), (F.lit(50) + reg % 200).cast("int").alias("seats")]


ACTIVITY_SQL = """
geo AS (SELECT n_nationkey AS code, CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((n_nationkey * 83) % 360 - 180 AS DOUBLE) AS lon FROM nation),
activity AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), CAST(round(l_extendedprice * 100) AS BIGINT))) AS flight_id,
         l_suppkey AS reg, CAST(l_shipdate AS DATE) AS date, CAST(date_trunc('month', l_shipdate) AS DATE) AS mon, r_name AS operator,
         'S' || (l_suppkey % 6) AS sub_series, 'M' || (l_suppkey % 3) AS master_series, s_nationkey AS origin, c_nationkey AS dest,
         CAST(50 + l_suppkey % 200 AS INTEGER) AS seats, l_quantity / 2 AS hours,
         CASE WHEN s_nationkey = c_nationkey THEN 0.0 ELSE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) END AS km,
         l_extendedprice / 1000 AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN geo a ON a.code = s_nationkey JOIN geo b ON b.code = c_nationkey
)"""


def snapshots(spark: SparkSession, sf_dir: str, flights: DataFrame | None = None) -> DataFrame:
    """Monthly rows of each aircraft, with gaps, changes of operator, months that two operators list, all statuses, and
    serials, sub-series and leases that are null or empty; and orders of types, some of which nobody has flown.

    The aircraft's months and operators are stored, a small table beside the lines: what reads the snapshots many times
    doesn't join and group the lines again. flights: the activity (reg, mon, operator, price), where it is stored."""
    a = activity(spark, sf_dir) if flights is None else flights
    rows = a.groupBy("reg", "mon", "operator").agg((F.sum(F.round(F.col("price") * 100000).cast("long")) / F.count("*") / 100003).alias("value"))
    rows = stored(rows).select("*", *_kind(F.col("reg")))
    n, reg = month_ordinal(F.col("mon")), F.col("reg")
    rows = rows.withColumn("n", n).where((reg + F.col("n")) % 7 != 0)
    twice = rows.withColumn("copy", F.explode(F.when((reg + F.col("n")) % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    turn = (reg + F.col("n")) % 23
    status = F.lit("In Service")
    for k, name in enumerate(OTHER_STATUSES):
        status = F.when(turn == k, name).otherwise(status)
    flown = twice.select(
        (reg * 1000000 + F.col("n") * 10 + F.col("copy")).alias("id"), F.col("n").cast("long").alias("revision_id"), F.col("mon").alias("period"), "reg",
        F.when(reg % 17 == 3, "").when(reg % 17 != 4, F.concat(F.lit("X-"), reg % 90)).alias("serial"), status.alias("status"),
        F.when(F.col("copy") == 1, F.concat(F.col("operator"), F.lit(" B"))).otherwise(F.col("operator")).alias("operator"),
        F.when(reg % 13 == 5, "").when(reg % 13 != 6, F.col("sub_series")).alias("sub_series"), "master_series", "seats", ((reg * 997) % 40000).alias("payload"),
        F.when(reg % 4 == 0, "").when(reg % 4 == 1, "Freight / Cargo").when(reg % 8 == 3, "Combi Cargo").when(reg % 8 == 7, "Utility").otherwise("Passenger").alias("usage"), "value",
        F.date_add(F.lit("1994-01-01").cast("date"), ((reg * 37) % 3000).cast("int")).alias("delivery_date"),
        F.when(reg % 9 == 0, "Wet").when(reg % 9 != 1, "Dry").alias("lease"), F.when(reg % 3 == 0, "Business").otherwise("Commercial").alias("plan_type"),
    )
    newest = rows.agg(F.max("n").cast("long").alias("revision_id"), F.max("mon").alias("period"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 40 = 0").select((F.col("p_partkey") / 40).cast("long").alias("j"))
    j = F.col("j")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_r"), F.col("r_name").alias("operator"))
    ordered = parts.join(regions, j % 5 == F.col("_r")).crossJoin(F.broadcast(newest)).select(  # one row
        (F.lit(9000000000) + j).alias("id"), "revision_id", "period", F.lit(None).cast("long").alias("reg"), F.concat(F.lit("ORD-"), "operator", F.lit("-"), j).alias("serial"),
        F.when(j % 4 == 0, "On order").when(j % 4 == 1, "LOI to Order").when(j % 4 == 2, "Reengineered").otherwise("Planned").alias("status"), "operator",
        F.concat(F.lit("N"), j % 3).alias("sub_series"), F.when(j % 7 == 0, "MX").otherwise(F.concat(F.lit("M"), j % 3)).alias("master_series"),
        (F.lit(100) + j % 50).cast("int").alias("seats"), F.lit(0).cast("long").alias("payload"), F.lit(None).cast("string").alias("usage"), F.lit(None).cast("double").alias("value"),
        F.when(j % 11 != 0, F.date_add(F.lit("1998-06-01").cast("date"), ((j * 37) % 1800).cast("int"))).alias("delivery_date"), F.lit(None).cast("string").alias("lease"), F.lit("Commercial").alias("plan_type"),
    )
    return flown.unionByName(ordered)


#: Statuses by (reg + month) % 23; in service beyond them.
OTHER_STATUSES = ["Retired", "On order", "Storage", "On option", "LOI to Order", "LOI to Option", "Type swap", "Reengineered", "Written off", "Cancelled", "Planned"]
SNAPSHOTS_SQL = (
    ACTIVITY_SQL
    + f""",
monthly AS (
  SELECT reg, mon, operator, sub_series, master_series, seats, sum(CAST(round(price * 100000) AS BIGINT)) / count(*) / 100003 AS value, year(mon) * 12 + month(mon) AS n
  FROM activity GROUP BY ALL
),
orders_ AS (SELECT p_partkey // 40 AS j, r_name AS operator FROM part JOIN region ON (p_partkey // 40) % 5 = r_regionkey WHERE p_partkey % 40 = 0),
snapshots AS (
  SELECT reg * 1000000 + n * 10 + copy AS id, CAST(n AS BIGINT) AS revision_id, mon AS period, reg,
         CASE reg % 17 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'X-' || (reg % 90) END AS serial,
         coalesce({OTHER_STATUSES}[(reg + n) % 23 + 1], 'In Service') AS status,
         CASE WHEN copy = 1 THEN operator || ' B' ELSE operator END AS operator, CASE reg % 13 WHEN 5 THEN '' WHEN 6 THEN NULL ELSE sub_series END AS sub_series, master_series,
         seats, (reg * 997) % 40000 AS payload,
         CASE WHEN reg % 4 = 0 THEN '' WHEN reg % 4 = 1 THEN 'Freight / Cargo' WHEN reg % 8 = 3 THEN 'Combi Cargo' WHEN reg % 8 = 7 THEN 'Utility' ELSE 'Passenger' END AS usage, value,
         CAST(DATE '1994-01-01' + CAST((reg * 37) % 3000 AS INTEGER) AS DATE) AS delivery_date, CASE reg % 9 WHEN 0 THEN 'Wet' WHEN 1 THEN NULL ELSE 'Dry' END AS lease,
         CASE WHEN reg % 3 = 0 THEN 'Business' ELSE 'Commercial' END AS plan_type
  FROM monthly, (VALUES (0), (1)) c(copy) WHERE (reg + n) % 7 <> 0 AND (copy = 0 OR (reg + n) % 5 = 0)
  UNION ALL
  SELECT 9000000000 + j, (SELECT max(n) FROM monthly WHERE (reg + n) % 7 <> 0), (SELECT max(mon) FROM monthly WHERE (reg + n) % 7 <> 0), NULL, 'ORD-' || operator || '-' || j,
         ['On order', 'LOI to Order', 'Reengineered', 'Planned'][j % 4 + 1], operator, 'N' || (j % 3), CASE WHEN j % 7 = 0 THEN 'MX' ELSE 'M' || (j % 3) END,
         CAST(100 + j % 50 AS INTEGER), 0, NULL, NULL, CASE WHEN j % 11 <> 0 THEN CAST(DATE '1998-06-01' + CAST((j * 37) % 1800 AS INTEGER) AS DATE) END, NULL, 'Commercial'
  FROM orders_
)"""
)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: events as samples of flights."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("fr24_id"), F.col("user_id").alias("reg"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_id") % 17 != 0, (k % 120 - 60).cast("double")).alias("lat"), F.when(F.col("event_id") % 17 != 0, F.floor(F.col("value") % 340).cast("double") - 170).alias("lon"),
        (F.col("value") * 40).alias("alt"), F.col("value").alias("gspeed"), ((k * 13) % 900 - 600).cast("double").alias("vspeed"), (F.col("user_id") % 30).alias("origin"),
    )


POSITIONS_SQL = """
geo AS (SELECT n_nationkey AS code, CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((n_nationkey * 83) % 360 - 180 AS DOUBLE) AS lon FROM nation),
positions AS (
  SELECT user_id AS fr24_id, user_id AS reg, ts AS timestamp, CASE WHEN event_id % 17 <> 0 THEN CAST(k % 120 - 60 AS DOUBLE) END AS lat,
         CASE WHEN event_id % 17 <> 0 THEN floor(value % 340) - 170 END AS lon, value * 40 AS alt, value AS gspeed, CAST((k * 13) % 900 - 600 AS DOUBLE) AS vspeed, user_id % 30 AS origin
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
