"""Streams, keyed sinks and bucket state on small tables that are written and written again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.operators.positions import running_distance
from skein.operators.snapshots import latest_by
from skein.sources import readers, sinks
from skein.streaming import live
from skein.streaming.state import BucketState

D = dt.date
SAMPLE = "fr24_id long, reg long, timestamp timestamp, lat double, lon double, alt double, gspeed double, origin long"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def samples(spark, *rows):
    """Rows of (fr24_id, timestamp, lon) along the equator; no position where lon is None."""
    return spark.createDataFrame([(f, (f or 0) * 10, t, None if lon is None else 0.0, lon, 0.0, 0.0, 9) for f, t, lon in rows], SAMPLE)


PLACES = [(1, 0.0, 0.0)]


def test_state_of_a_flight_ends_after_the_watermark(spark, tmp_path):
    """Two batches that a later one follows: a late sample gets a step of no time, a flight that is over leaves no state."""
    live.rocksdb(spark)
    places = spark.createDataFrame(PLACES, "code long, lat double, lon double")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(*rows):
        samples(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = live.with_distance(live.deduplicated(spark.readStream.schema(SAMPLE).parquet(source), "1 hour"), places)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress

    run((1, at(1, 0), 0.0), (1, at(1, 0, 10), 1.0), (2, at(1, 0), 0.0))
    run((1, at(1, 0, 5), 2.0), (1, at(1, 0, 10), 1.0), (1, at(1, 0, 20), 3.0))  # late but in time, repeated, new
    run((3, at(3), 0.0))  # the watermark passes both flights
    last = run((3, at(3, 0, 1), 1.0), (1, at(1, 0, 30), 9.0))  # flight 1 again, a day too late
    got = {(r.fr24_id, r.timestamp): (round(r.distance, 1), r.time_delta) for r in spark.read.parquet(out).collect()}
    assert got == {
        (1, at(1, 0)): (0.0, 0.0), (1, at(1, 0, 10)): (111.2, 600.0), (2, at(1, 0)): (0.0, 0.0), (1, at(1, 0, 5)): (222.4, 0.0), (1, at(1, 0, 20)): (333.6, 900.0),
        (3, at(3)): (0.0, 0.0), (3, at(3, 0, 1)): (111.2, 60.0),
    }
    assert last is not None
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "flight").load(state)
    assert {r.key.fr24_id for r in left.select("key").collect()} == {3}


def test_a_batch_that_is_written_twice_is_there_once(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["fr24_id", "timestamp"]
    rows = samples(spark, (1, at(5), 1.0), (1, at(5), 1.0), (1, at(5), 2.0), (2, at(5), None), (None, at(5), 3.0), (None, at(5), 3.0)).unionByName(samples(spark, (3, None, 1.0)))
    assert sinks.append_by_month(rows, path, keys, batch_id=0) and not sinks.append_by_month(rows, path, keys, batch_id=0)
    first = spark.read.parquet(path)
    assert first.count() == 4 and first.where("fr24_id = 1").first().lon == 1.0
    more = rows.unionByName(samples(spark, (4, at(6), 1.0))).unionByName(samples(spark, (1, dt.datetime(2024, 2, 1), 1.0)))
    for _ in range(2):  # without a marker, as after a stop between rows and marker
        sinks.append_by_month(more, path, keys)
    assert spark.read.parquet(path).count() == 6
    target = spark.read.parquet(path).where("month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in target


def test_buckets_survive_a_batch_that_stops_or_is_run_again(spark, tmp_path):
    schema = spark.createDataFrame([], "reg long, timestamp timestamp, v int").schema
    state = BucketState(spark, str(tmp_path / "s"), schema, "reg", 8)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    run = live.upsert_state(state, "timestamp")
    run(rows(*[(k, at(1), k) for k in range(40)], (None, at(1), 0)), 0)
    before = state.commit()[1]

    def broken(old, new):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        state.upsert(rows((1, at(2), 100)), 1, broken)
    assert state.commit() == (0, before) and state.read().count() == 40
    for _ in range(2):
        run(rows((1, at(2), 100), (2, at(0 + 1), 1), (77, at(1), 7)), 1)
    got = {r.reg: r.v for r in state.read().collect()}
    assert got == {**{k: k for k in range(40)}, 1: 100, 2: got[2], 77: 7} and got[2] in (1, 2)
    number, lies = state.commit()
    assert number == 1 and set(lies.values()) == {0, 1} and sum(v == 1 for v in lies.values()) <= 3  # only what was touched
    for k in range(2, 5):
        run(rows(*[(r, at(k + 1), k) for r in range(40)]), k)
    assert {r.v for r in state.read().where("reg < 40").collect()} == {4} and len(state._names("commits")) == 2


def test_a_stream_that_is_restarted_keeps_the_newest(spark, tmp_path):
    source, name = str(tmp_path / "in"), str(tmp_path / "s")
    schema = spark.createDataFrame([], "reg long, timestamp timestamp, lon double").schema
    everything = [(k, at(1 + (k * 7 + j) % 20, j), float(j)) for k in range(12) for j in range(6)]
    for part in (everything[:30], everything[30:]):
        samples(spark, *part).write.mode("append").parquet(source)
        state = BucketState(spark, name, schema, "reg", 4)  # anew, as after a restart
        stream = spark.readStream.schema(SAMPLE).parquet(source).select(*schema.names)
        stream.writeStream.foreachBatch(live.upsert_state(state, "timestamp")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = latest_by(samples(spark, *everything), ["reg"], [F.col("timestamp").desc()]).select(*schema.names)
    assert sorted(map(tuple, state.read().collect())) == sorted(map(tuple, want.collect()))


def test_a_late_sample_changes_the_totals_after_it(spark, tmp_path):
    places = spark.createDataFrame(PLACES, "code long, lat double, lon double")
    base, totals = str(tmp_path / "samples"), str(tmp_path / "totals")
    add = lambda *rows: samples(spark, *rows).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(base)
    add((1, at(1, 23), 0.0), (1, at(2, 1), 2.0), (1, at(2, 2), 3.0), (2, at(1), 0.0), (2, at(1, 1), 5.0))
    stored = lambda: spark.read.schema(SAMPLE + ", day date").parquet(base)
    first = running_distance(stored(), places).select("fr24_id", "reg", "timestamp", "lat", "lon", "distance", "time_delta", "day")
    first.write.partitionBy("day").parquet(totals)
    add((1, at(2, 1, 30), 9.0))
    live.recompute_tail(stored(), places, totals, dt.date(2024, 1, 2))
    got = {(r.fr24_id, r.timestamp): round(r.distance / 111.195, 1) for r in spark.read.parquet(totals).collect()}
    assert got == {(1, at(1, 23)): 0.0, (1, at(2, 1)): 2.0, (1, at(2, 1, 30)): 9.0, (1, at(2, 2)): 15.0, (2, at(1)): 0.0, (2, at(1, 1)): 5.0}
    live.recompute_tail(stored(), places, totals, dt.date(2025, 1, 1))  # nothing there
    assert spark.read.parquet(totals).count() == 6


def test_a_database_is_read_by_ranges(spark, tmp_path):
    """Spark's own embedded database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, D(2024, 1 + k % 12, 1), f"v{k}") for k in range(200)] + [(None, None, "none")], "id int, day date, v string")
    rows.write.format("jdbc").options(url=url, dbtable="facts").save()
    for column in ("id", "day"):
        got = readers.read_ranges(spark, url, "facts", column, 5)
        assert got.rdd.getNumPartitions() == 5 and sorted(r.V for r in got.select(F.col("v").alias("V")).collect()) == sorted(r.v for r in rows.collect())
    assert readers.read_ranges(spark, url, "facts", "id", 1).count() == 201


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.createDataFrame([(k, D(2024, 1 + k % 12, 1)) for k in range(48)], "v int, mon date").write.partitionBy("mon").parquet(path)
    rows = readers.read_months(spark, path, "v int, mon date", D(2024, 3, 17), D(2024, 5, 2))
    assert sorted({r.mon.month for r in rows.collect()}) == [3, 4, 5] and readers.read_months(spark, path, "v int, mon date").count() == 48
    assert "PartitionFilters: [isnotnull(mon" in rows._jdf.queryExecution().executedPlan().toString()


def test_flights_into_table_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("1", None, "R", "c", at(5)), ("1", None, "R", "c", at(5))], "fr24_id string, flight string, reg string, callsign string, first_seen timestamp")
    table, csv = str(tmp_path / "t"), str(tmp_path / "c")
    for mode in ("db", "csv", "both"):
        sinks.store_flights(rows, mode, table, csv)
    assert spark.read.parquet(table).count() == 1 and spark.read.option("header", True).csv(csv).count() == 4
    with pytest.raises(ValueError):
        sinks.store_flights(rows, "none")


def test_the_roster_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "roster")
    assert readers.read_roster(spark, path).count() == 0
    for rows in ([("R1", "A", 1), ("R2", "B", None)], [("R2", "B", 2)]):
        sinks.store_roster(spark.createDataFrame(rows, "reg string, operator string, airline_id long"), path)
    assert [tuple(r) for r in readers.read_roster(spark, path).collect()] == [("R2", "B", 2)]
