"""Sources: flight summaries, schedules, airports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import empty_as_null
from .sinks import exists

FLIGHT_SCHEMA = (
    "fr24_id string, flight string, callsign string, operating_as string, painted_as string, type string, reg string, category string, hex string, "
    "orig_icao string, orig_iata string, dest_icao string, dest_iata string, dest_icao_actual string, dest_iata_actual string, "
    "runway_takeoff string, runway_landed string, datetime_takeoff timestamp, datetime_landed timestamp, flight_time int, "
    "actual_distance double, circle_distance double, first_seen timestamp, last_seen timestamp, flight_ended boolean"
)
FLIGHT_KEY = ["fr24_id", "flight", "reg", "callsign"]
STOP = "iataCode string, icaoCode string, terminal string, gate string, baggage string, delay int, scheduledTime timestamp, estimatedTime timestamp, actualTime timestamp, estimatedRunway timestamp, actualRunway timestamp"
NUMBER = "number string, iataNumber string, icaoNumber string"
AIRLINE = "name string, iataCode string, icaoCode string"
SCHEDULE_SCHEMA = f"type string, status string, departure struct<{STOP.replace(' string', ': string').replace(' int', ': int').replace(' timestamp', ': timestamp')}>, arrival struct<{STOP.replace(' string', ': string').replace(' int', ': int').replace(' timestamp', ': timestamp')}>, airline struct<{AIRLINE.replace(' string', ': string')}>, flight struct<{NUMBER.replace(' string', ': string')}>, codeshared struct<airline: struct<{AIRLINE.replace(' string', ': string')}>, flight: struct<{NUMBER.replace(' string', ': string')}>>"
SCHEDULE_KEY = ["type", "dep_scheduled", "dep_iata", "arr_iata", "flight_number"]


def read_flight_summary(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; records that can't be read, and those without an id, are left out. Times are UTC."""
    rows = spark.read.schema(FLIGHT_SCHEMA + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record IS NULL AND fr24_id IS NOT NULL AND fr24_id <> ''").drop("_corrupt_record")


def split_ended(flights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ended flights and those still flying; a null flag is neither."""
    return flights.where("flight_ended"), flights.where("NOT flight_ended")


def null_safe_anti(df: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    a, b = df.alias("a"), target.select(*key).distinct().alias("b")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def append_new(df: DataFrame, target: DataFrame, key: list[str] = FLIGHT_KEY) -> DataFrame:
    """The rows of df, one for each key, that target doesn't have; nulls of a key are equal."""
    return null_safe_anti(df.dropDuplicates(key), target, key)


def flatten_schedules(df: DataFrame, json_col: str = "json") -> DataFrame:
    """One row of plain columns from each schedule; objects that are missing give nulls."""
    s = df.select(F.from_json(json_col, SCHEDULE_SCHEMA).alias("s")).select("s.*")
    stop = {"iata": "iataCode", "icao": "icaoCode", "terminal": "terminal", "gate": "gate", "delay": "delay", "scheduled": "scheduledTime", "estimated": "estimatedTime", "actual": "actualTime", "estimated_runway": "estimatedRunway", "actual_runway": "actualRunway"}
    out: list[Column] = [F.col("type"), F.col("status")]
    out += [F.col(f"departure.{v}").alias(f"dep_{k}") for k, v in stop.items()]
    out += [F.col(f"arrival.{v}").alias(f"arr_{k}") for k, v in stop.items() if k != "gate"] + [F.col("arrival.gate").alias("arr_gate"), F.col("arrival.baggage").alias("arr_baggage")]
    for prefix, path in (("", ""), ("codeshared_", "codeshared.")):
        out += [F.col(f"{path}airline.{v}").alias(f"{prefix}airline_{k}") for k, v in (("name", "name"), ("iata", "iataCode"), ("icao", "icaoCode"))]
        out += [F.col(f"{path}flight.{v}").alias(f"{prefix}flight_{k}") for k, v in (("number", "number"), ("iata", "iataNumber"), ("icao", "icaoNumber"))]
    return s.select(*out)


def dedup_schedules(df: DataFrame, target: DataFrame) -> DataFrame:
    return append_new(df, target, SCHEDULE_KEY)


#: How much of an airport each type is, the best first.
TYPE_RANK = ["large_airport", "medium_airport", "small_airport", "seaplane_base", "heliport", "balloonport", "closed"]


#: Continents by their codes.
CONTINENTS = {"AF": "Africa", "AN": "Antarctica", "AS": "Asia", "EU": "Europe", "NA": "North America", "OC": "Oceania", "SA": "South America"}


def _keyword(length: int) -> Column:
    """The first keyword of so many upper-case letters."""
    tokens = F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), lambda k: F.trim(k))
    return F.get(F.filter(tokens, lambda k: k.rlike(f"^[A-Z]{{{length}}}$")), 0)


def _best_by_iata(rows: DataFrame) -> DataFrame:
    """rows with iata and from_keyword. One row per IATA code: its own code before one from the keywords, open before
    closed, larger types, scheduled service, then the smaller id. Rows without a code stay."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPE_RANK)), F.col("type")), F.lit(0)), F.lit(len(TYPE_RANK) + 1))
    w = Window.partitionBy("iata").orderBy("from_keyword", F.col("type").eqNullSafe("closed"), rank, ~F.col("scheduled_service").eqNullSafe("yes"), "id")
    return rows.where("iata IS NOT NULL").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").unionByName(rows.where("iata IS NULL"))


def build_airports(airports: DataFrame, countries: DataFrame, runways: DataFrame) -> DataFrame:
    """One row per IATA code, the best candidate (see _best_by_iata). Open runways are an array."""
    strips = runways.where(F.coalesce(F.col("closed"), F.lit("0")) != "1").groupBy("airport_ident").agg(F.array_sort(F.collect_list(F.struct("le_ident", "he_ident", "length_ft", "width_ft", "surface"))).alias("runways"))
    mined, own = _keyword(3), empty_as_null(F.trim("iata_code"))
    best = _best_by_iata(airports.withColumn("iata", F.coalesce(own, mined)).withColumn("from_keyword", own.isNull() & mined.isNotNull()))
    names = countries.select(F.col("code").alias("iso_country"), F.col("name").alias("country"))
    return best.join(names, "iso_country", "left").join(strips, best["ident"] == strips["airport_ident"], "left").drop("airport_ident")


def airport_reference(airports: DataFrame, countries: DataFrame, runways: DataFrame) -> DataFrame:
    """The airport table from the three source files, whose columns are text: codes, names, places, types and open runways.

    An ICAO code is the airport's own, else its ident if that is four upper-case letters, else such a keyword; an IATA code
    its own, else a keyword. Numbers that can't be read and empty texts are null. One row per IATA code, see _best_by_iata.
    """
    text = lambda c: empty_as_null(F.col(c))
    number = lambda c, t: F.expr(f"try_cast({c} AS {t})")
    strip = F.struct(
        text("le_ident").alias("le_ident"), text("he_ident").alias("he_ident"), number("length_ft", "int").alias("length_ft"), number("width_ft", "int").alias("width_ft"),
        text("surface").alias("surface"), number("le_heading_degT", "double").alias("le_heading"), number("he_heading_degT", "double").alias("he_heading"),
    )
    strips = runways.where(F.coalesce(F.col("closed"), F.lit("0")) != "1").groupBy(F.col("airport_ident").alias("ident")).agg(F.array_sort(F.collect_list(strip)).alias("runways"))
    own, icao = empty_as_null(F.trim("iata_code")), empty_as_null(F.trim("icao_code"))
    by_ident = F.when(F.trim("ident").rlike("^[A-Z]{4}$"), F.trim("ident"))
    rows = airports.withColumns({"iata": F.coalesce(own, _keyword(3)), "icao": F.coalesce(icao, by_ident, _keyword(4)), "from_keyword": own.isNull() & _keyword(3).isNotNull(), "id": number("id", "int")})
    continent = F.create_map(*[F.lit(x) for pair in CONTINENTS.items() for x in pair])
    names = countries.select(F.col("code").alias("iso_country"), F.col("name").alias("country"))
    best = _best_by_iata(rows).join(names, "iso_country", "left").join(strips, "ident", "left")
    return best.select(
        "id", "iata", text("ident").alias("ident"), "icao", text("name").alias("name"), text("municipality").alias("city"), "country", text("iso_country").alias("iso_country"), number("longitude_deg", "double").alias("lon"),
        number("latitude_deg", "double").alias("lat"), text("type").alias("type"), number("elevation_ft", "int").alias("elevation_ft"), text("iso_region").alias("iso_region"),
        F.try_element_at(continent, F.coalesce("continent", F.lit(""))).alias("continent"), text("continent").alias("continent_code"), "from_keyword", "runways", text("keywords").alias("keywords"),
    )


def apply_overrides(airports: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: (iata, city, country). Curated names replace the others."""
    o = overrides.select("iata", F.col("city").alias("_city"), F.col("country").alias("_country"))
    return airports.join(o, "iata", "left").withColumn("city", F.coalesce("_city", "city")).withColumn("country", F.coalesce("_country", "country")).drop("_city", "_country")


def explode_runways(airports: DataFrame) -> DataFrame:
    """A row per runway; its threshold's coordinates are (0, 0) unless there are exactly two numbers."""
    rows = airports.select("icao", F.explode("runways").alias("r"))
    two = F.size("r.thr_coordinates") == 2
    return rows.select("icao", "r.designator", "r.heading", "r.length", *[F.when(two, F.get("r.thr_coordinates", F.lit(k))).otherwise(F.lit(0.0)).alias(n) for k, n in enumerate(("lat", "lon"))])


def new_airports(airports: DataFrame, known: DataFrame) -> DataFrame:
    """Airports that known has neither by ICAO nor by IATA."""
    return airports.join(known.where("icao IS NOT NULL").select("icao").distinct(), "icao", "left_anti").join(known.where("iata IS NOT NULL").select("iata").distinct(), "iata", "left_anti")


def read_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int = 32, **options: str) -> DataFrame:
    """A database's table in parts by ranges of a number or date column, each read by a task of its own over a connection of
    its own. The bounds are asked for first; rows without the column are read with the first range, none is left out."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}", **options).load().first()
    low, high = bounds[0], bounds[1]
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if low is None or low == high or parts == 1:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def read_months(spark: SparkSession, path: str, schema: str, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """A fact table that is partitioned by mon, from the month of since to that of until: other months' files aren't listed
    as input. schema: with mon, so that no file is opened to find it."""
    rows = spark.read.schema(schema).parquet(path)
    for day, keep in ((since, F.col("mon").__ge__), (until, F.col("mon").__le__)):
        rows = rows.where(keep(F.lit(day.replace(day=1)))) if day else rows
    return rows


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(reg, operator, airline_id) as sinks.store_roster left it; empty before the first time."""
    schema = "reg string, operator string, airline_id long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
