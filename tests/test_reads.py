"""How often a query's plan reads the lines, by far the largest table: what it reads twice it also shuffles twice."""

import os
import re
import time

import pytest

from pyspark.sql import functions as F

from skein.operators import fleet as L
from skein.operators import research as E
from skein.operators.numbering import numbered_within
from skein.plans import adaptors as A
from skein.plans import job_queries as J
from skein.plans import panel_queries as P
from skein.plans import research_queries as Q
from skein.session import stored
from skein.sources import sinks
from skein.sources.sinks import write_in_order

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(df) -> int:
    return sum("Relation [" in line and "l_shipdate" in line for line in plan(df).splitlines())


@pytest.mark.parametrize("name", ["assemble_actuals", "scope_filter", "aircraft_information", "geo_attach", "usage_validate", "grouped_panel", "fleet_presence"])
def test_lines_are_read_once_at_most(spark, name):
    assert reads(P.QUERIES[name](spark, SF)) <= 1


@pytest.mark.parametrize("name", ["route_impute", "airport_lookups", "merge_panel"])
def test_nothing_after_the_stored_tables_reads_the_lines(spark, name):
    assert reads(P.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["exog_evaluate", "exog_settings", "exog_summary"])
def test_research_stores_the_flights(spark, name):
    assert reads(Q.QUERIES[name](spark, SF)) == 0


@pytest.fixture
def kept(monkeypatch):
    """The plans that a query of the job stores, in order."""
    made = []
    for part in (A, J):
        monkeypatch.setattr(part, "stored", lambda df: made.append(df) or stored(df))
    return made


def test_reported_flights_meet_their_orders_and_are_hashed_once(spark, kept):
    J.reported_actuals(spark, SF)
    assert sum(reads(df) for df in kept) == 1
    assert sum(plan(df).count("md5(") for df in kept) == 1


def test_code_of_reported_flights_is_small_enough_to_be_compiled(spark, kept):
    """The JVM interprets methods of more than 8000 bytes. Joins are as in a large table's plan: only airports are broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")
        J.reported_actuals(spark, SF)
        explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
        sizes = [int(n) for df in kept for n in re.findall(r"maxMethodCodeSize:(\d+)", explain(df._jdf.queryExecution(), "codegen"))]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) <= 8000, sizes


def test_what_follows_a_table_is_done_when_it_is_written(spark, tmp_path):
    source, there = stored(spark.range(3)), []
    folder = source.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    tables = {"a": lambda t: source, "b": lambda t: there.append(os.path.isdir(folder)) or t["a"].selectExpr("id + 1 AS id")}
    out = write_in_order(spark, tables, str(tmp_path), then={"a": lambda: J.discard(source)})
    assert there == [False] and sorted(r.id for r in out["b"].collect()) == [1, 2, 3]


def test_anchor_panel_counts_aircraft_and_days_without_repeating_flights(spark):
    rows = [("A", "M", "2000-01-01", r, d, 1.0, float(k), 10 * k) for k, (r, d) in enumerate([(1, "2000-01-02"), (1, "2000-01-02"), (1, None), (2, "2000-01-03"), (None, "2000-01-03")])]
    rows += [(None, "", None, 3, None, 2.0, None, None)]
    flights = spark.createDataFrame(rows, "operator string, master_series string, mon string, reg int, date string, hours double, km double, seats int").withColumns({c: F.to_date(c) for c in ("mon", "date")})
    out = E.anchor_panel(flights)
    assert "Expand" not in plan(out)
    got = {r.sf: (r.carrier, r.flown, r.tail_days, r.cycles, r.block_hours, r.sum_km, r.med_haul, r.seats_med) for r in out.collect()}
    assert got == {"M": ("A", 2, 4, 5, 5.0, 10.0, 2.0, 20.0), "NA": (None, 1, 1, 1, 2.0, None, None, None)}


def test_lines_are_dealt_only_by_order(spark):
    rows = A.activity(spark, SF)
    shuffles = [x for x in rows._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
    assert all("l_orderkey" in x for x in shuffles), shuffles


def test_numbering_deals_stored_rows_no_more(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("v"))
    out = numbered_within(rows, ["g"], [F.col("v")], "n")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.v): r.n for r in out.collect()}
    for g in range(3):
        assert [got[g, v] for v in sorted(v for h, v in got if h == g)] == list(range(1, sum(h == g for h, _ in got) + 1))


def test_fleet_keeps_flights_where_they_are(spark):
    flights = A.activity(spark, SF).withColumns({"value": F.lit(1.0), "usage": F.lit("Passenger"), "lease": F.lit("Dry"), "delivery_date": F.col("date")})
    assert not any("SortMergeJoin" in x and "operator" in x and "mon" in x for x in L.build_fleet(A.snapshots(spark, SF), flights)._jdf.queryExecution().sparkPlan().toString().splitlines())


def test_the_panels_rows_are_dealt_once_to_get_their_values(spark):
    """With tables too large to be broadcast, but for the types' benchmarks: those are known when the rows are planned."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
        joins = [x for x in P.merge_panel(spark, SF)._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum("SortMergeJoin" in x for x in joins) == 1 and sum("BroadcastHashJoin" in x for x in joins) == 1, joins


def test_shuffle_files_go_when_a_table_is_stored(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        files = manager.getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}

    before = shuffles()
    table = stored(spark.range(1000).repartition(3))
    ends = time.time() + 20
    while shuffles() - before and time.time() < ends:
        time.sleep(0.5)
    assert not shuffles() - before and table.count() == 1000


def test_a_table_that_is_made_in_turns_is_whole(spark, tmp_path, monkeypatch):
    """Months, one of them unknown, in turns of few bytes: each row is there once, and few files hold a month."""
    source = stored(spark.range(5000).select("id", F.when(F.col("id") % 13 > 0, F.add_months(F.lit("2000-01-01").cast("date"), (F.col("id") % 13).cast("int"))).alias("mon")))
    monkeypatch.setattr(sinks, "TURN_BYTES", sinks.input_bytes(source) // 4)
    tables = {"a": lambda t: source.withColumn("twice", F.col("id") * 2), "b": lambda t: t["a"].groupBy("mon").agg(F.sum("twice").alias("s"))}
    writes = []
    freed = sinks.freeing
    monkeypatch.setattr(sinks, "freeing", lambda spark: writes.append(1) or freed(spark))
    out = write_in_order(spark, tables, str(tmp_path), {"a": ["mon"], "b": ["mon"]}, turns={"a": "year(mon) * 12 + month(mon)", "b": "year(mon) * 12 + month(mon)"})
    assert len(writes) > 4  # several turns for either table
    assert sorted((r.id, r.mon, r.twice) for r in out["a"].collect()) == sorted((r.id, r.mon, 2 * r.id) for r in source.collect())
    assert out["b"].count() == 13 and out["b"].agg(F.sum("s")).first()[0] == 4999 * 5000
    assert all(len([f for f in os.listdir(tmp_path / "a" / m) if f.endswith(".parquet")]) <= sinks.FILES_PER_PARTITION for m in os.listdir(tmp_path / "a") if "=" in m)


def test_the_panels_query_leaves_the_rollup_alone(spark):
    """Of the job's large tables; each goes when no other reads it."""
    folder = J.forecast_panel(spark, SF).inputFiles()[0].removeprefix("file:").split("/grouped/")[0]
    large = {"assembled", "actuals", "stubs", "pool", "pools", "forecast", "panel", "grouped"}
    assert large & set(os.listdir(folder)) == {"grouped"}
