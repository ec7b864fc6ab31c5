"""Small cases that the driver's tables don't hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import calendar, places, scalars
from skein.operators import coverage, fit, fleet, panel, positions, project, research, snapshots
from skein.sources import readers, sinks
from skein.streaming import live

D = dt.date


def test_contract_year_at_the_anchor(spark):
    days = [D(2001, 6, 14), D(2001, 6, 15), D(2001, 6, 16), D(2004, 2, 29)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    assert [r[0] for r in df.select(calendar.contract_year(F.col("d"), D(2020, 6, 15))).collect()] == ["CY2000", "CY2000", "CY2001", "CY2003"]
    assert calendar.year_floor(D(2024, 2, 29), 1) == D(2023, 2, 28)


def test_flight_hours_and_age(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, t + dt.timedelta(hours=2), 99), (t, t - dt.timedelta(hours=1), 3600), (t, t + dt.timedelta(hours=20), 7200), (t, None, 80000), (None, None, None)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp, s int")
    assert [r[0] for r in df.select(scalars.flight_hours(F.col("a"), F.col("b"), F.col("s"))).collect()] == [2.0, 1.0, 2.0, None, None]
    ages = spark.createDataFrame([(D(2000, 1, 1), D(2001, 1, 1)), (D(2002, 1, 1), D(2001, 1, 1)), (None, D(2001, 1, 1))], "a date, b date")
    assert [r[0] for r in ages.select(scalars.age(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


def test_unknown_distance_is_dropped_by_three_valued_logic(spark):
    flights = spark.createDataFrame([("f1", 1, D(2001, 1, 5), 1, 1, 1.0, 500.0), ("f2", 1, D(2001, 1, 5), 1, 2, 1.0, None), ("f3", 1, D(2001, 3, 5), 1, 2, 1.0, 800.0)], "flight_id string, reg long, date date, origin long, dest long, hours double, km double")
    snap = spark.createDataFrame([(1, 7, D(2001, 1, 1), 1, "A"), (2, 8, D(2001, 1, 1), 1, "B")], "id long, revision_id long, period date, reg long, operator string")
    for c, t in (("sub_series", "string"), ("master_series", "string"), ("seats", "int"), ("payload", "long"), ("usage", "string"), ("value", "double"), ("delivery_date", "date"), ("lease", "string")):
        snap = snap.withColumn(c, F.lit(None).cast(t))
    rows = panel.assemble_actuals(flights, snap, D(2001, 6, 15)).collect()
    assert [(r.flight_id, r.operator) for r in rows] == [("f3", "B")]  # carried forward, the newer operator
    assert not panel.assemble_actuals(flights, snap, D(2001, 6, 15), operators=["A"]).collect()  # scope comes last
    assert len(panel.assemble_actuals(flights, snap, D(2001, 6, 15), keep_unknown=True).collect()) == 2


def test_null_period_is_the_live_revision(spark):
    rev = spark.createDataFrame([("C", 5, D(2001, 1, 1)), ("C", 9, None), ("C", 7, D(2001, 2, 1))], "plan_type string, revision_id long, period date")
    assert [r.revision_id for r in snapshots.latest_revisions(rev).collect()] == [9]


def test_value_slope_never_rises_and_fill_goes_back_then_forward(spark):
    values = spark.createDataFrame([("A", 1, 10, 5.0), ("A", 1, 12, 7.0), ("A", 2, 10, 5.0), ("A", 2, 12, 3.0)], "operator string, reg long, ord int, av double")
    assert {r.reg: r.slope for r in panel.value_stats(values).collect()} == {1: 0.0, 2: -1.0}
    cells = spark.createDataFrame([("A", 1, 9), ("A", 1, 11), ("A", 1, 14)], "operator string, reg long, ord int")
    assert sorted((r.ord, r.filled) for r in panel.value_fill(cells, values).collect()) == [(9, 5.0), (11, 5.0), (14, 7.0)]


def test_geography_takes_each_field_from_its_first_source(spark):
    rows = [("X", 2, "b", "c2", "n2", 1.0, 2.0), ("X", 1, "", "c1", None, None, 3.0)]
    got = places.geo_lookup(spark.createDataFrame(rows, "code string, prio int, city string, country string, airport_name string, lat double, lon double")).first()
    assert (got.city, got.country, got.airport_name, got.lat, got.lon) == ("b", "c1", "n2", 1.0, 3.0)


def test_params_are_checked():
    assert fit.Params().check().level_window == 15
    with pytest.raises(ValueError):
        fit.Params(level_window=2).check()
    with pytest.raises(ValueError):
        fit.Params(level_l=12, level_window=6).check()


def brute_islands(rows, gap):
    out = []
    for a, b in sorted(rows):
        if out and (a - out[-1][1]).days <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_intervals_against_plain_python(spark):
    rng = random.Random(4)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(r, day(a := rng.randrange(60)), day(a + rng.randrange(6))) for r in range(6) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "reg long, from_date date, to_date date")
    for gap in (1, 7):
        got = {}
        for r in coverage.coalesce_intervals(df, gap).collect():
            got.setdefault(r.reg, []).append((r.from_date, r.to_date))
        assert {k: sorted(v) for k, v in got.items()} == {k: brute_islands([(a, b) for x, a, b in rows if x == k], gap) for k in got}
    windows = spark.createDataFrame([(r, day(3), day(50)) for r in range(7)], "reg long, start date, stop date")
    gaps = coverage.complement(df, windows)
    open_days = {(r, day(k)) for r in range(7) for k in range(3, 51)} - {(r, a + dt.timedelta(days=k)) for r, a, b in rows for k in range((b - a).days + 1)}
    spread = lambda r, a, b: [(r, a + dt.timedelta(days=k)) for k in range((b - a).days + 1)]
    found = [x for r in gaps.collect() for x in spread(r.reg, r.from_date, r.to_date)]
    assert len(found) == len(set(found)) and set(found) == open_days
    groups = coverage.segment_groups(gaps).collect()
    found = [x for g in groups for r in g.regs for x in spread(r, g.from_date, g.to_date)]
    assert len(found) == len(set(found)) and set(found) == open_days
    chunks = [x for c in coverage.chunk_ranges(coverage.segment_groups(gaps), 3, 2).collect() for r in c.regs for x in spread(r, c.from_date, c.to_date)]
    assert len(chunks) == len(set(chunks)) and set(chunks) == open_days


def test_running_distance_seeds_and_carries(spark):
    t = lambda k: dt.datetime(2024, 1, 1, 0, k)
    rows = [(1, t(0), 0.0, 0.0, 100.0, 9), (1, t(1), None, None, 100.0, 9), (1, t(2), 0.0, 1.0, 200.0, 9), (2, t(0), 0.0, 1.0, 50.0, 1), (2, t(1), 0.0, 2.0, 50.0, 1)]
    df = spark.createDataFrame(rows, "fr24_id long, timestamp timestamp, lat double, lon double, gspeed double, origin int")
    geo = spark.createDataFrame([(1, 0.0, 0.0)], "code int, lat double, lon double")
    got = {(r.fr24_id, r.timestamp.minute): round(r.distance, 1) for r in positions.running_distance(df, geo).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.0, (1, 2): 73.0, (2, 0): 111.2, (2, 1): 222.4}


def test_rare_routes_stay_out_of_the_robust_pool(spark):
    rows = [("A", "S", "M", D(y, 3, 1), 1, 2, 500.0, 1.0, f"{y}") for y in (1999, 2000, 2001)] + [("A", "S", "M", D(2000, 3, k), 1, 3, 500.0, 1.0, f"b{k}") for k in range(1, 20)]
    df = spark.createDataFrame(rows, "operator string, sub_series string, master_series string, date date, origin int, dest int, km double, hours double, flight_id string")
    assert [(r.dest, r.rn) for r in project.robust_pool(df).collect()] == [(2, 1)]


def test_append_new_takes_nulls_as_equal(spark):
    schema = "fr24_id string, flight string, reg string, callsign string"
    old = spark.createDataFrame([("1", None, "r", "c")], schema)
    new = spark.createDataFrame([("1", None, "r", "c"), ("2", None, "r", "c"), ("2", None, "r", "c")], schema)
    assert [r.fr24_id for r in readers.append_new(new, old).collect()] == ["2"]


def test_flight_summary_skips_bad_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"fr24_id": "a", "flight_ended": true, "first_seen": "2024-01-01T00:00:00Z"}\nnonsense\n{"flight_ended": false}\n{"fr24_id": "b", "flight_ended": false}\n{"fr24_id": "c"}\n')
    rows = readers.read_flight_summary(spark, str(tmp_path))
    ended, flying = readers.split_ended(rows)
    assert rows.count() == 3 and [r.fr24_id for r in ended.collect()] == ["a"] and [r.fr24_id for r in flying.collect()] == ["b"]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([("A", 1), ("B", 1)], "operator string, v int"), path, ["operator"])
    sinks.overwrite_partitions(spark.createDataFrame([("B", 2)], "operator string, v int"), path, ["operator"])
    assert sorted((r.operator, r.v) for r in spark.read.parquet(path).collect()) == [("A", 1), ("B", 2)]


SNAPSHOT = "id long, revision_id long, period date, reg string, serial string, status string, operator string, sub_series string, master_series string, seats int, payload long, usage string, value double, delivery_date date, lease string, plan_type string"


def snapshot(spark, rows):
    return spark.createDataFrame([(i, rev, per, reg, ser, st, op, "SS", "MS", 100, 1, "Passenger", 1.0, deliv, "Dry", "Commercial") for i, rev, per, reg, ser, st, op, deliv in rows], SNAPSHOT)


def test_one_dead_row_keeps_an_airframe_out(spark):
    day = D(2001, 5, 1)
    rows = [
        (1, 9, day, "R1", "S1", "Retired", "A", None), (2, 9, day, "R1b", "S1", "In Service", "A", None),  # a stale row beside the retired one
        (3, 9, day, "R2", "S2", "In Service", "A", None), (4, 12, D(2001, 6, 1), "R2", "S2", "Retired", "B", None),  # retired by another operator
        (5, 8, D(2001, 4, 1), "R3", "S3", "Written off", "A", None), (6, 9, day, "R3", "S3", "Storage", "A", None),  # dead in an older revision only
        (7, 9, day, "R4", "", "In Service", "A", None), (8, 9, day, "R4", "S9", "Retired", "A", None),  # no serial: the registration decides
    ]
    snap = snapshot(spark, rows)
    alive = fleet.not_dead(fleet.fleet_identity(snap), snap)
    assert sorted(r.reg for r in alive.collect()) == ["R2", "R3"]


def test_the_newest_revision_goes_by_its_period(spark):
    rows = [
        (1, 20, D(2001, 3, 1), "R1", "S1", "In Service", "A", D(2002, 1, 5)), (2, 11, D(2001, 5, 1), "R2", "S2", "On order", "A", D(2002, 2, 5)),  # numbers out of order
    ]
    got = panel.future_aircraft(snapshot(spark, rows), D(2001, 6, 15)).collect()
    assert [(r.reg, r.cy) for r in got] == [("R2", None)]
    live = (3, 5, None, "R3", "S3", "In Service", "A", D(2002, 3, 5))  # a revision without a period is live
    assert [r.reg for r in panel.future_aircraft(snapshot(spark, [*rows, live]), D(2001, 6, 15)).collect()] == ["R3"]


def test_scope_and_reported_ends(spark):
    snap = snapshot(spark, [(1, 1, D(2001, 1, 1), "R1", "S1", "In Service", "A", None), (2, 1, D(2001, 1, 1), "R2", "S2", "In Service", "B", None)])
    assert [r.reg for r in panel.scoped(snap, ["A"]).collect()] == ["R1"] and panel.scoped(snap, ["A"], ["R2"]).count() == 2 == panel.scoped(snap).count()
    for bad in (dict(operators=[]), dict(operators=[], regs=[]), dict(operators=["Z"])):
        with pytest.raises(ValueError):
            panel.check_scope(snap, **bad)
    t = dt.datetime(2001, 1, 5)
    flights = spark.createDataFrame([("f1", "R1", D(2001, 1, 5), "AAAA", "", "BBBB", t, t + dt.timedelta(hours=2), 0, 900.0), ("f2", "R1", D(2001, 1, 5), "", "CCCC", "BBBB", t, t, 0, 900.0), ("f3", "R1", D(2001, 1, 5), "AAAA", None, "", t, t, 0, 900.0)], "flight_id string, reg string, date date, orig string, dest_actual string, dest_planned string, departed timestamp, landed timestamp, seconds int, km double")
    flown = panel.with_hours(panel.with_route(flights))
    assert [(r.flight_id, r.dest, r.hours) for r in flown.collect()] == [("f1", "BBBB", 2.0)]
    assert panel.assemble_actuals(flown, snap, D(2001, 6, 15)).count() == 1 and panel.assemble_actuals(flown, snap, D(2001, 6, 15), since=D(2001, 1, 5)).count() == 0


def test_routes_with_null_ends_stay_in_the_pool(spark):
    rows = [(f"f{y}{k}", "A", "SS", D(y, 3, 5), o, d, a, 900.0, 2.0) for y in (2000, 2001) for k, (o, d, a) in enumerate([("X", "Y", None), ("X", None, None), ("X", "Y", "Z")])]
    actuals = spark.createDataFrame(rows, "flight_id string, operator string, sub_series string, date date, origin string, dest string, dest_actual string, km double, hours double")
    assert {(r.origin, r.dest) for r in project.robust_pool(actuals).collect()} == {("X", "Y"), ("X", None)}
    assert {(r.dest, r.dest_actual) for r in project.robust_pool(actuals, ["origin", "dest", "dest_actual"]).collect()} == {("Y", None), (None, None), ("Y", "Z")}


def test_fetch_starts_restamped_years_and_scoped_registrations(spark):
    snap = snapshot(spark, [(1, 1, D(2001, 1, 1), "R1", "S1", "In Service", "A", D(2004, 3, 31)), (2, 2, D(2001, 2, 1), "R1", "S1", "In Service", "A", D(2005, 1, 1)), (3, 1, D(2001, 1, 1), "R2", "S2", "In Service", "A", None), (4, 1, D(2000, 1, 1), "", "S3", "In Service", "A", None)])
    assert [(r.reg, r.start) for r in panel.fetch_starts(snap).collect()] == [("R1", D(2004, 2, 29))]
    assert [r.reg for r in panel.scoped_registrations(snap, D(2001, 2, 1), ["A"]).collect()] == ["R1"]
    assert sorted(r.reg for r in panel.scoped_registrations(snap, D(2000, 1, 1), ["A"]).collect()) == ["R1", "R2"]
    rows = spark.createDataFrame([(D(2001, 6, 16), "CY2001"), (None, "CY1999")], "date date, cy string")
    assert [r.cy for r in panel.restamp(rows, D(2020, 6, 16)).collect()] == ["CY2000", "CY1999"]


def test_months_of_either_side_stay_in_the_series(spark):
    snap = snapshot(spark, [(1, 1, D(2001, 1, 1), "R1", "S1", "In Service", "A", None), (2, 2, D(2001, 1, 1), "R1", "S1", "Retired", "A", None), (3, 3, D(2001, 2, 1), "R1", "S1", "In Service", "A", None)])
    flown = spark.createDataFrame([("A", D(2001, 3, 1))], "operator string, mon date")
    got = research.monthly_series(snap, flown, D(2001, 1, 1)).orderBy("mon").collect()
    assert [(r.mon, r.in_service, r.flights) for r in got] == [(D(2001, 2, 1), 1, None), (D(2001, 3, 1), None, 1)]


def test_forward_runs_two_years_beyond_launch_and_needs_a_horizon(spark):
    rows = [("A", "M", D(2000 + k // 12, k % 12 + 1, 1), 2, 10 + k % 3, 9000.0, 100.0) for k in range(18)]
    months = spark.createDataFrame(rows, "carrier string, sf string, mon date, flown int, cycles int, sum_km double, seats_med double")
    got = research.forward(months, D(2001, 6, 1), D(2001, 8, 20)).orderBy("mon").collect()
    assert (got[0].mon, got[-1].mon, len(got)) == (D(2001, 7, 1), D(2003, 8, 1), 26)
    assert all(r.lo < r.flights < r.hi and r.pax == pytest.approx(r.flights * 80) for r in got) and got[0].hi / got[0].lo < got[-1].hi / got[-1].lo
    with pytest.raises(ValueError):
        research.forward(months, D(2001, 6, 1), D(1999, 6, 20))
    with pytest.raises(ValueError):
        research.backtest(months, D(2001, 6, 1), phi=1.0)


def test_derived_tables_read_what_was_written(spark, tmp_path):
    one = spark.createDataFrame([(1,), (2,)], "v int")
    made = sinks.write_in_order(spark, {"a": lambda t: one, "b": lambda t: t["a"].where("v > 1")}, str(tmp_path))
    assert [r.v for r in made["b"].collect()] == [2] and spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_plain_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 2, 5)), (None, dt.datetime(2024, 2, 6))], "v int, timestamp timestamp")
    sinks.write_csv(rows, str(tmp_path / "c"))
    sinks.write_json(rows.select("v"), str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.schema("v int").json(str(tmp_path / "j")).count() == 3
    new = spark.createDataFrame([(9, dt.datetime(2024, 3, 1))], rows.schema)
    assert sorted(r.v or 0 for r in sinks.replace_scope(rows, new, F.col("v") > 1).collect()) == [0, 1, 9]


def test_airport_sources(spark):
    known = spark.createDataFrame([("AAAA", "AAA"), (None, "BBB"), ("CCCC", None)], "icao string, iata string")
    found = spark.createDataFrame([("AAAA", "XXX"), ("BBBB", "BBB"), ("CCCC", "CCC"), ("DDDD", "DDD"), (None, None)], "icao string, iata string")
    assert sorted(str(r.icao) for r in readers.new_airports(found, known).collect()) == ["DDDD", "None"]
    places_ = spark.createDataFrame([("AAA", "old", "X"), ("BBB", "b", "Y")], "iata string, city string, country string")
    names = spark.createDataFrame([("AAA", "new", None)], "iata string, city string, country string")
    assert {(r.iata, r.city, r.country) for r in readers.apply_overrides(places_, names).collect()} == {("AAA", "new", "X"), ("BBB", "b", "Y")}
    strips = spark.createDataFrame([("AAAA", [("09", 90.0, 1000, [1.0, 2.0]), ("27", 270.0, 1000, [1.0])])], "icao string, runways array<struct<designator string, heading double, length int, thr_coordinates array<double>>>")
    assert [(r.designator, r.lat, r.lon) for r in readers.explode_runways(strips).collect()] == [("09", 1.0, 2.0), ("27", 0.0, 0.0)]
    plan = spark.createDataFrame([("departure", None, "A", "B", "1"), ("departure", None, "A", "B", "1"), ("arrival", None, "A", "B", "1")], "type string, dep_scheduled timestamp, dep_iata string, arr_iata string, flight_number string")
    assert [r.type for r in readers.dedup_schedules(plan, plan.where("type = 'departure'")).collect()] == ["arrival"]


def test_latest_states(spark):
    t = lambda k: dt.datetime(2024, 1, 1, k)
    rows = spark.createDataFrame([(1, 10, t(1), 0.0, 0.0, 1.0, 1.0), (2, 10, t(2), 0.0, 0.0, 2.0, 1.0)], "fr24_id long, reg long, timestamp timestamp, lat double, lon double, alt double, gspeed double")
    assert [(r.reg, r.fr24_id, r.alt) for r in live.latest_state(rows).collect()] == [(10, 2, 2.0)]
    assert [r[0] for r in spark.createDataFrame([("",), (None,), ("x",)], "k string").select(scalars.key_or_na(F.col("k"))).collect()] == ["NA", "NA", "x"]
