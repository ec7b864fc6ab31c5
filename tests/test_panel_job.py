"""Fleet, plan, values and the composed panel on rows that the driver's tables don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import places, scalars
from skein.operators import fit, fleet, job, panel, positions, project, research, snapshots
from skein.operators.numbering import numbered_within, quantiles_within
from skein.session import stored
from skein.sources import sinks

D = dt.date
DAY = D(2001, 5, 1)
SNAPSHOT = (
    "id long, revision_id long, period date, reg string, serial string, status string, operator string, sub_series string, master_series string, "
    "value double, delivery_date date, lease string, seats int, payload long, usage string, plan_type string, manufacturer string, lease_type string, lessor string"
)


def snapshot(spark, *rows):
    """Rows of (id, reg, serial, status, operator, sub_series, master_series, value, delivery_date, lease), all of one revision."""
    return spark.createDataFrame([(i, 9, DAY, reg, ser, st, op, sub, ms, val, dl, lease, 100, 0, "Passenger", "Commercial", "F", None, None) for i, reg, ser, st, op, sub, ms, val, dl, lease in rows], SNAPSHOT)


def flights(spark, *rows):
    """Rows of (flight_id, operator, sub_series, master_series, reg, date, value, lease)."""
    schema = "flight_id string, operator string, sub_series string, master_series string, reg string, date date, value double, lease string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"mon": F.trunc("date", "month"), "seats": F.lit(100), "usage": F.lit("Passenger"), "delivery_date": F.lit(None).cast("date"), "origin": F.lit("X"), "dest": F.lit("Y"), "km": F.lit(900.0), "hours": F.lit(2.0)})


def test_only_known_statuses_are_aircraft(spark):
    names = ["In Service", "Storage", "On order", "On option", "LOI to Order", "LOI to Option", "Type swap", "Reengineered", "Planned", "Cancelled", "Unknown", "Retired", None]
    snap = snapshot(spark, *[(k, f"R{k}", f"S{k}", st, "A", "SS", "MS", 1.0, D(2002, 1, 1), None) for k, st in enumerate(names)])
    got = fleet.build_fleet(snap, flights(spark).where("false"))
    assert sorted((r.reg, r.is_order) for r in got.collect()) == [(f"R{k}", k > 1) for k in range(8)]


def test_airframes_without_series_or_serial(spark):
    rows = [
        (1, "R1", "S1", "In Service", "A", None, "MS", 1.0, None, None), (2, "R2", "S2", "In Service", "A", "", "MS", 1.0, None, None),  # two serials of an unknown sub-series
        (3, "R3", None, "In Service", "A", "S", "MS", 1.0, None, None), (4, "R3", "", "In Service", "A", "T", "MS", 1.0, None, None),  # one registration in two sub-series
        (5, "", "", "In Service", "A", "S", "MS", 1.0, None, None), (6, None, None, "In Service", "A", "S", "MS", 1.0, None, None),  # no key at all
        (7, "A6-", "ABC-A320-77", "On order", "A", "N", "MS", None, D(2002, 1, 1), None), (8, "A6-", "ABC-A320-78", "On order", "A", "N", "MS", None, None, None),  # an order without a date
        (9, "R9", "S9", "On order", "A", "S", "MS", 1.0, D(2002, 1, 1), None), (10, "R9", "S9", "In Service", "A", "S", "MS", 1.0, D(2001, 1, 1), None),  # delivered, with its order left over
    ]
    got = fleet.build_fleet(snapshot(spark, *rows), flights(spark).where("false"))
    assert sorted((r.reg, r.sub_series, r.is_order) for r in got.collect()) == [("A6-N-77", "N", True), ("R1", "NA", False), ("R2", "NA", False), ("R3", "S", False), ("R3", "T", False), ("R9", "S", False)]
    shown = spark.createDataFrame([("A6-", "ABY-A320-124349", "A320-251N neo"), ("", None, None), (None, "7", "S"), ("A6-ARI", "13343", "S")], "reg string, serial string, sub string")
    assert [r[0] for r in shown.select(scalars.shown_registration(F.col("reg"), F.col("serial"), F.col("sub"))).collect()] == ["A6-A320-251N neo-124349", "-", "S-7", "A6-ARI"]


def test_a_tail_that_flew_for_another_operator_is_taken_in(spark):
    snap = snapshot(spark, (1, "R1", "S1", "In Service", "A", "SS", "MS", 1.0, None, None), (2, "R2", None, "On order", "B", "SS", "MS", 1.0, None, None), (3, "R3", "S3", "Retired", "B", "SS", "MS", 1.0, None, None))
    a = flights(spark, ("1", "B", "SS", "MS", "R1", D(2001, 4, 5), 1.0, "Wet"), ("2", "B", None, "MS", "R1", D(2001, 4, 6), 1.0, "Wet"), ("3", "B", "SS", "MS", "R2", D(2001, 4, 6), 1.0, None), ("4", "B", "SS", "MS", "R3", D(2001, 3, 6), 1.0, None))
    got = fleet.build_fleet(snap, a).where("operator = 'B'")
    # R2 is B's own, though its row (an order without serial) is no aircraft; R3 didn't fly in the last month.
    assert sorted((r.reg, r.sub_series, r.is_sup) for r in got.collect()) == [("R1", "NA", True), ("R1", "SS", True)]


def history(spark):
    rows = [(f"{y}{m}{k}{r}", "A", "S1", "M1", f"R{r}", D(y, m, 1 + k), 5.0, None) for y in (1999, 2000) for m in range(1, 13) for r in range(2) for k in range(4)]
    a = flights(spark, *rows)
    return a.withColumn("dest", F.concat(F.lit("Y"), F.day("date")))


def test_types_that_nobody_has_flown(spark):
    """A new type flies by its master series; one of an unknown master series doesn't; its aircraft come when delivered."""
    snap = snapshot(
        spark, (1, "R0", "S0", "In Service", "A", "S1", "M1", 5.0, None, None), (2, "R1", "S1", "In Service", "A", "S1", "M1", 5.0, None, None), (3, "A6-", "N-1", "On order", "A", "S2", "M1", None, D(2001, 3, 10), None),
        (4, "A6-", "N-2", "On order", "A", "S3", "M9", None, D(2001, 3, 10), None), (5, "A6-", "N-3", "On order", "A", "S2", "M1", None, D(2009, 1, 1), None),
    )
    a, as_of, p = stored(history(spark)), D(2001, 1, 1), fit.Params(min_route_pool=2)
    f = stored(fleet.build_fleet(snap, a))
    types = stored(fleet.fleet_types(f))
    plan = stored(fit.month_plan(fit.fit_two_grains(types, a, p), fit.spans(a.groupBy("operator").agg(F.max("date").alias("last_fact")), as_of, p)))
    assert {(r.sub_series, r.history_key) for r in plan.collect()} == {("S1", "S1"), ("S2", "M1")}
    pool = stored(project.robust_pool(a))
    tiers = stored(project.choose_tier(types, a, pool, p))
    assert {(r.sub_series, r.tier) for r in tiers.collect()} == {("S1", 1), ("S2", 3), ("S3", 3)}
    months = plan.select("operator", "mon").distinct()
    got = project.generate_flights(fleet.in_service(f, months), plan, tiers, project.route_pools(a, tiers, pool), as_of, p).collect()
    new = [r for r in got if r.sub_series == "S2"]
    assert {r.reg for r in new} == {"A6-S2-1"} and min(r.mon for r in new) == D(2001, 3, 1) and {r.dest for r in new} <= {"Y1", "Y2", "Y3", "Y4"}
    assert {r.sub_series for r in got} == {"S1", "S2"} and all(r.cy == ("CY2000" if r.date <= D(2001, 1, 1) else r.cy) for r in got)
    rows = project.coefficients(project.plan_templates(plan, a, fit.operator_frontier(a, p), p), fleet.active_fleet(f, months))
    assert len(rows.columns) == 16
    march = {r.sub_series: r for r in rows.where("forecast_month = '2001-03-01'").collect()}
    assert march["S2"].active_fleet == 1 and march["S2"].history_key == "M1" and march["S1"].active_fleet == 2 and march["S1"].template_month == D(2000, 3, 1)
    assert march["S1"].forecast_flights == march["S1"].flights_per_aircraft * 2


def test_months_never_seen_have_the_factor_one(spark):
    h = spark.createDataFrame([("A", D(2001, m, 1), 10 * m) for m in (1, 2, 3)], "k string, mon date, flights long")
    got = {r.cal: (r.seas, r.n) for r in fit.seasonal_fit(h, ["k"], 3.0).collect()}
    assert got[7] == (1.0, 0) and got[1][1] == 1 and got[1][0] != 1.0


def test_values_of_operators_leases_and_types(spark):
    snap = snapshot(spark, (1, "R1", "S1", "In Service", "A", "S", "M", 4.0, None, "Wet"), (2, "R2", "S2", "In Service", "B", "S", "M", 8.0, None, None), (3, "R3", "S3", "In Service", "B", None, "M", 2.0, None, None))
    assert {r.sub_series: r.benchmark for r in panel.type_benchmark(snap).collect()} == {"S": 6.0, "NA": 2.0}
    cols = "operator string, reg string, date date, cy string, value double, lease string, sub_series string, delivery_date date"
    a = spark.createDataFrame(
        [("A", "R", D(2000, 1, 5), "CY1999", 10.0, None, "S", None), ("A", "R", D(2000, 3, 5), "CY1999", 8.0, None, "S", None), ("B", "R", D(2000, 9, 5), "CY2000", 3.0, None, "S", None),
         ("A", "Q", D(2000, 1, 5), "CY1999", 0.0, None, "S", None), ("A", "W", D(2000, 1, 5), "CY1999", 9.0, "Wet", "S", None), ("A", "N", None, "CY1999", None, None, "", None), ("A", "F", None, None, 7.0, None, "S", None)], cols)
    f = spark.createDataFrame([("A", "R", D(2000, 5, 5), "CY1999", None, None, "S", D(2000, 5, 9)), ("A", "new", D(2000, 5, 5), "CY1999", None, None, "S", None)], cols)
    got = {(r.data_type, r.operator, r.reg, r.date and r.date.month): (r.agreed_value, r.age) for r in panel.merge_panel(a, f, snap).collect()}
    assert got == {
        ("Actuals", "A", "R", 1): (10.0, None), ("Actuals", "A", "R", 3): (8.0, None), ("Actuals", "B", "R", 9): (3.0, None), ("Actuals", "A", "Q", 1): (0.0, None), ("Actuals", "A", "W", 1): (0.0, None),
        ("Actuals", "A", "N", None): (2.0, None), ("Forecast", "A", "R", 5): (6.0, 0.0), ("Forecast", "A", "new", 5): (6.0, None),
    }


def test_great_circle_of_unknown_places(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, None)], "a double, b double, c double, d double")
    for form in ("asin", "atan2"):
        got = [r[0] for r in df.select(scalars.great_circle(F.col("a"), F.col("b"), F.col("c"), F.col("d"), form)).collect()]
        assert got[0] == pytest.approx(111.19, abs=0.01) and got[1:] == [None, None]


def test_samples_of_one_time_have_their_own_totals(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 0.0, 0.0, 0.0, 9), (1, t, 0.0, 1.0, 0.0, 9), (1, t, 0.0, 2.0, 0.0, 9)], "fr24_id long, timestamp timestamp, lat double, lon double, gspeed double, origin int")
    geo = spark.createDataFrame([(1, 0.0, 0.0)], "code int, lat double, lon double")
    assert sorted(round(r.distance, 1) for r in positions.running_distance(df, geo).collect()) == [0.0, 111.2, 222.4]


def test_missing_aircraft_are_taken_in_as_landed(spark):
    t, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)
    state = spark.createDataFrame([("R1", "A", "en-route", t), ("R2", "B", "en-route", t)], "reg string, operator string, status string, last_update timestamp")
    roster = spark.createDataFrame([("R1",), ("R2",), ("R3",), ("R3",), (None,)], "reg string")
    batch = spark.createDataFrame([("R1", "A", "en-route", dt.datetime(2024, 1, 2))], state.schema)
    got = {r.reg: (r.operator, r.status, r.last_update) for r in positions.aircraft_state(state, batch, roster, F.lit(now)).collect()}
    assert got == {"R1": ("A", "en-route", dt.datetime(2024, 1, 2)), "R2": ("B", "landed", now), "R3": (None, "landed", now)}


def test_growth_counts_carriers_that_can_be_validated(spark):
    rows = [("a", True, 1.2, 4.0, 5.0, 0.8), ("b", True, 1.04, 2.0, 3.0, 0.9), ("c", True, 0.94, -1.0, 2.0, 1.0), ("d", False, 2.0, 90.0, 90.0, 0.0), ("e", True, None, 1.0, 1.0, 1.0)]
    r = research.growth_read(spark.createDataFrame(rows, "carrier string, validatable boolean, n_growth double, bias double, mape double, coverage double")).first()
    assert (r.carriers, r.grew, r.stable, r.shrank, r.grew_bias, r.stable_mape, r.shrank_coverage) == (3, 1, 1, 1, 4.0, 3.0, 1.0)


def test_flights_per_aircraft_and_month(spark):
    rows = [("A", "X", "Y", r, D(2001, m, 1)) for m in range(1, 13) for r in ((1, 2) if m == 1 else (1,))]
    got = research.archetype_features(spark.createDataFrame(rows, "operator string, origin string, dest string, reg long, mon date"), 1, 12).first()
    assert got.per_tail_month == pytest.approx(13 / (2 * 12))  # 13 flights of 2 aircraft in 12 months
    assert research.valley(spark.createDataFrame([("a", 1.0)], "carrier string, score double")).first().threshold == 0.0


def test_usage_is_checked_on_coarse_labels(spark):
    rows = [("Passenger", 100, 0), ("Freight / Cargo", 0, 30000), ("Combi Cargo", 100, 0), ("Utility", 100, 0), ("", 100, 0), (None, 0, 30000)]
    r = fleet.usage_check(spark.createDataFrame(rows, "usage string, seats int, payload int")).first()
    assert (r.tails, r.labelled, r.checked, r.correct, r.freighters, r.freighters_found, r.null_passenger, r.null_freight) == (6, 4, 3, 2, 2, 1, 1, 1)


def test_numbers_within_a_group_that_lies_in_many_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.hash("id").alias("v"), "id").repartition(9)
    got = {}
    for r in numbered_within(df, ["k"], [F.col("v"), F.col("id")], "rn").collect():
        got.setdefault(r.k, []).append((r.rn, r.v, r.id))
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_quantiles_of_a_skewed_group(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("k"), F.when(F.col("id") % 7 != 0, (F.hash("id") % 50) / 4).alias("v")).repartition(9)
    df = df.unionByName(spark.createDataFrame([("one", 3.0), ("none", None)], "k string, v double"))
    at = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.975, "e": 1.0}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()]).where("a IS NOT NULL").collect()
    got = {r.k: r for r in quantiles_within(df, ["k"], "v", at).collect()}
    assert len(got) == len(want) and all(got[w.k][n] == pytest.approx(w[n]) for w in want for n in at)


def test_routes_are_repaired_by_their_means(spark):
    rows = [("1", "A", "X", "Y", 1000.0, 1.5), ("2", "A", "X", "Y", None, None), ("3", "A", "X", "Y", 0.0, 90.0), ("4", "B", "X", "Y", None, 1.0), ("5", "A", None, "Y", 0.0, 1.0), ("6", "A", "P", "Q", 800.0, 40.0)]
    got = {r.flight_id: (r.km, r.hours) for r in panel.route_impute(spark.createDataFrame(rows, "flight_id string, operator string, origin string, dest string, km double, hours double")).collect()}
    assert got == {"1": (1000.0, 1.5), "2": (1000.0, 1.5), "3": (1000.0, 1.5), "4": (None, 1.0), "5": (0.0, 1.0), "6": (800.0, 1.5)}


def test_the_job_from_reported_flights_to_rollups(spark, tmp_path):
    """A small run end to end: what is dropped, carried forward, stubbed, projected and merged."""
    t = lambda d, h: dt.datetime(d.year, d.month, d.day, h)
    rows = []
    for k in range(60):
        d = D(2000, 1 + k % 12, 1 + k // 12)
        rows.append((f"f{k}", "R1", d, t(d, 1), t(d, 3), "AAA", "BBB", "", "AAAA", "BBBB", None, 1000.0, 7200))
    d = D(2000, 12, 20)
    rows += [
        ("same", "R1", d, t(d, 1), t(d, 3), "AAA", "AAA", "BBB", "AAAA", "AAAA", "BBBB", 1.0, 1), ("noicao", "R1", d, t(d, 1), t(d, 3), "AAA", "BBB", "", "", "BBBB", "", 1.0, 1),
        ("far", "R1", d, t(d, 1), t(d, 3), "AAA", "ZZZ", "", "AAAA", "ZZZZ", "", 1.0, 1), ("late", "R1", D(2002, 1, 1), None, None, "AAA", "BBB", "", "AAAA", "BBBB", "", 1.0, 1),
        ("icao", "R1", d, t(d, 1), None, "CCC", "BBB", "", "AAAA", "BBBB", "", None, 36), ("nocode", "R1", d, t(d, 1), None, "", "BBB", "", "AAAA", "BBBB", "", None, 36),
    ]
    schema = "flight_id string, reg string, date date, departed timestamp, landed timestamp, origin string, dest string, dest_actual string, origin_icao string, dest_icao string, dest_icao_actual string, reported_km double, reported_seconds int"
    reported = spark.createDataFrame(rows, schema)
    snap = snapshot(spark, (1, "R1", "S1", "In Service", "A", "SS", "MS", 9.0, D(1999, 1, 1), None), (2, "A6-", "N-5", "LOI to Order", "A", "TT", "MS", None, D(2001, 9, 9), None)).withColumn("period", F.lit("2000-01-01").cast("date"))
    iata = places.geo_lookup(spark.createDataFrame([("AAA", 1, "a", "one", None, 0.0, 0.0), ("BBB", 1, None, "two", None, 0.0, 9.0)], "code string, prio int, city string, country string, airport_name string, lat double, lon double"))
    icao = places.geo_lookup(spark.createDataFrame([("AAAA", 4, None, "uno", None, 0.0, 0.0)], "code string, prio int, city string, country string, airport_name string, lat double, lon double"))
    out = job.run_panel(reported, snap, iata, icao, D(2001, 6, 15), str(tmp_path), fit.Params(min_route_pool=1))
    facts = {r.flight_id: r for r in out["actuals"].collect()}
    assert len(facts) == 61 and "icao" in facts and facts["icao"].hours == pytest.approx(facts["icao"].km / 800 + 0.5) and facts["f0"].km == pytest.approx(1000.75, abs=0.1)
    assert {(r.mon, r.cy) for r in out["stubs"].where("reg = 'R1'").collect()} == {(D(2000, 6, 1), "CY2000")} | {(D(2001, m, 1), "CY2000") for m in range(1, 7)}  # in June 2000 it flew before the 16th only
    coming = out["forecast"].where("sub_series = 'TT'")
    assert coming.count() > 0 and coming.agg(F.min("mon")).first()[0] == D(2001, 9, 1) and {r.reg for r in coming.select("reg").distinct().collect()} == {"A6-TT-5"}
    merged = out["panel"]
    assert merged.where("data_type = 'Actuals'").count() == 61 + 7 and merged.where("data_type = 'Forecast'").count() == out["forecast"].count()
    one = merged.where("data_type = 'Forecast' AND reg = 'R1'").first()
    assert (one.origin_country, one.dest_country, one.agreed_value, one.cy[:2]) == ("one", "two", 9.0, "CY")
    assert merged.where("data_type = 'Forecast' AND sub_series = 'TT' AND agreed_value IS NOT NULL").count() == 0  # no value and no benchmark
    grouped = out["grouped"].agg(F.sum("flights")).first()[0]
    assert grouped == 61 + out["forecast"].count()
    plan = spark.read.parquet(str(tmp_path / "panel")).where("mon = '2000-05-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mon" in plan


def test_one_month_is_rebuilt(spark, tmp_path):
    facts = spark.createDataFrame([("A", D(2001, 1, 1), 1), ("A", D(2001, 2, 1), 2), ("B", D(2001, 3, 1), 4)], "operator string, mon date, v long")
    make = lambda part: part.groupBy("operator", "mon").agg(F.sum("v").alias("v"))
    path = str(tmp_path / "rollup")
    make(facts.withColumn("v", F.lit(9))).write.partitionBy("mon").parquet(path)
    changed = spark.createDataFrame([("A", D(2001, 2, 1)), ("B", D(2001, 3, 1)), ("B", None)], "operator string, mon date")
    assert sinks.refresh_months(spark, facts.where("operator = 'A'"), make, path, changed) == 2
    assert sorted((r.operator, r.mon.month, r.v) for r in spark.read.parquet(path).collect()) == [("A", 1, 9), ("A", 2, 2)]
    assert snapshots.ORDER[2] == "LOI to Order"


def test_an_empty_roster_changes_nothing(spark):
    known = spark.createDataFrame([("R1",), ("R2",)], "reg string")
    retired = snapshot(spark, (1, "R1", "S1", "Retired", "A", "S", "M", 1.0, None, None))
    assert snapshots.roster_changes(known, retired).count() == 0
    one = snapshot(spark, (1, "R1", "S1", "Storage", "A", "S", "M", 1.0, None, None), (2, "R3", "S3", "In Service", "A", "S", "M", 1.0, None, None))
    assert sorted(map(tuple, snapshots.roster_changes(known, one).collect())) == [("R2", "drop"), ("R3", "add")]
