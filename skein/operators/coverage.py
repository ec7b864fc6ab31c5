"""Interval operators: which dates of which aircraft are covered, missing, and how to fetch them. Dates are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_intervals(df: DataFrame, gap: int, key: str = "reg") -> DataFrame:
    """(key, from_date, to_date) merged where the next begins at most ``gap`` days after all before it ended."""
    w = Window.partitionBy(key).orderBy("from_date", "to_date")
    before = F.max("to_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.datediff("from_date", before) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")).drop("_island")


def fold(ledger: DataFrame, days: DataFrame, cut: Column, gap: int = 7) -> DataFrame:
    """The ledger with the data days up to cut folded in; days join over ``gap``, the result over touching days."""
    seen = days.where(F.col("date") <= cut).select("reg", F.col("date").alias("from_date"), F.col("date").alias("to_date"))
    return coalesce_intervals(ledger.select("reg", "from_date", "to_date").unionByName(coalesce_intervals(seen, gap)), 1)


def complement(covered: DataFrame, windows: DataFrame) -> DataFrame:
    """windows: (reg, start, stop), one an aircraft. The parts of each window that covered leaves open."""
    inside = windows.join(covered, "reg").where((F.col("to_date") >= F.col("start")) & (F.col("from_date") <= F.col("stop")))
    merged = coalesce_intervals(inside.select("reg", F.greatest("from_date", "start").alias("from_date"), F.least("to_date", "stop").alias("to_date")), 1)
    marks = merged.select("reg", "from_date", "to_date").unionByName(windows.select("reg", F.date_add("stop", 1).alias("from_date"), F.lit(None).cast("date").alias("to_date")))
    before = F.lag("to_date").over(Window.partitionBy("reg").orderBy("from_date"))
    gaps = marks.join(windows, "reg").withColumn("_a", F.coalesce(F.date_add(before, 1), F.col("start"))).withColumn("_b", F.date_sub("from_date", 1))
    return gaps.where("_a <= _b").select("reg", F.col("_a").alias("from_date"), F.col("_b").alias("to_date"))


def segment_groups(gaps: DataFrame) -> DataFrame:
    """Gaps of many aircraft as maximal (from_date, to_date, regs): the dates are cut at every gap's begin and end, and
    neighbouring pieces with one set of aircraft are joined. Each aircraft meets only the boundaries within its gaps: the
    months that a gap touches are the join key."""
    bounds = gaps.select(F.explode(F.array("from_date", F.date_add("to_date", 1))).alias("b")).distinct().withColumn("m", F.trunc("b", "month"))
    own = gaps.withColumn("m", F.explode(F.sequence(F.trunc("from_date", "month"), F.trunc(F.date_add("to_date", 1), "month"), F.expr("interval 1 month"))))
    cuts = own.join(bounds, "m").where((F.col("b") >= F.col("from_date")) & (F.col("b") <= F.date_add("to_date", 1)))
    nxt = F.lead("b").over(Window.partitionBy("reg", "from_date").orderBy("b"))
    pieces = cuts.withColumn("e", nxt).where(F.col("e").isNotNull()).select("reg", "b", "e")
    sets = pieces.groupBy("b", "e").agg(F.array_sort(F.collect_set("reg")).alias("regs")).withColumn("h", F.md5(F.array_join("regs", ",").cast("binary")))
    same = Window.partitionBy("h", "regs").orderBy("b")
    sets = sets.withColumn("_new", F.coalesce((F.lag("e").over(same) != F.col("b")).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    return sets.groupBy("h", "regs", "_i").agg(F.min("b").alias("from_date"), F.date_sub(F.max("e"), 1).alias("to_date")).select("from_date", "to_date", "regs")


def plan_requests(groups: DataFrame, days: int = 14, batch: int = 15) -> DataFrame:
    """The cost of each group (requests of at most so many days and aircraft); newest first is by from_date."""
    length = F.datediff("to_date", "from_date") + 1
    cost = F.greatest(F.lit(1), F.ceil(length / days)) * F.ceil(F.size("regs") / batch)
    return groups.select("from_date", "to_date", F.size("regs").cast("long").alias("aircraft"), cost.cast("long").alias("requests"))


def chunk_ranges(groups: DataFrame, days: int = 14, batch: int = 15) -> DataFrame:
    """Each group as requests: ranges of at most ``days`` days for at most ``batch`` aircraft."""
    step = groups.withColumn("a", F.explode(F.sequence("from_date", "to_date", F.expr(f"interval {days} days"))))
    step = step.withColumn("b", F.least(F.date_add("a", days - 1), F.col("to_date"))).withColumn("k", F.explode(F.sequence(F.lit(0), ((F.size("regs") - 1) / batch).cast("int"))))
    return step.select(F.col("a").alias("from_date"), F.col("b").alias("to_date"), F.slice("regs", F.col("k") * batch + 1, batch).alias("regs"))


def advance_ledger(ledger: DataFrame, fetched: DataFrame, days: DataFrame, cut: Column) -> DataFrame:
    """fetched: (reg, from_date, to_date) ranges that were asked for. Each counts as covered up to its last day with data,
    or up to the cut if that is later, but never beyond its end; nothing before its begin."""
    last = fetched.join(days, "reg").where((F.col("date") >= F.col("from_date")) & (F.col("date") <= F.col("to_date"))).groupBy("reg", "from_date", "to_date").agg(F.max("date").alias("last"))
    ends = fetched.join(last, ["reg", "from_date", "to_date"], "left").withColumn("upto", F.least(F.greatest("last", F.least(F.col("to_date"), cut)), F.col("to_date")))
    new = ends.where("upto >= from_date").select("reg", "from_date", F.col("upto").alias("to_date"))
    return coalesce_intervals(ledger.unionByName(new), 1)
