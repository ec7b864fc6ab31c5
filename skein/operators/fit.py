"""Seasonality, levels and the month plan of all operators and sub-fleets at once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month
from ..functions.scalars import key_or_na


@dataclass(frozen=True)
class Params:
    """Defaults of the forecast; see check()."""

    level_window: int = 15
    level_complete_frac: float = 0.85
    level_l: int = 3
    seas_k: float = 3.0
    frontier_frac: float = 0.6
    frontier_window: int = 9
    min_route_pool: int = 5
    horizon_years: int = 2
    pax_load_factor: float = 0.8
    history_start: dt.date | None = None  # flights before it are no history

    def check(self) -> Params:
        ranges = {
            "level_window": (3, 36), "level_complete_frac": (0.1, 1.0), "level_l": (1, 12), "seas_k": (0, 24), "frontier_frac": (0.1, 1.0), "frontier_window": (3, 36),
            "min_route_pool": (1, 100), "horizon_years": (1, 10), "pax_load_factor": (0.1, 1.0),
        }
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.level_l > self.level_window:
            raise ValueError("level_l must not be above level_window")
        return self


def monthly_history(actuals: DataFrame, key: str) -> DataFrame:
    """Flights and distinct aircraft per operator, key and month."""
    return actuals.groupBy("operator", key, "mon").agg(F.count("*").alias("flights"), F.count_distinct("reg").alias("tails"))


def global_frontier(actuals: DataFrame, frac: float = 0.6) -> DataFrame:
    """One row: the last month with at least frac of the median month's flights."""
    months = actuals.groupBy("mon").agg(F.count("*").alias("flights"))
    return months.crossJoin(F.broadcast(months.agg(F.median("flights").alias("m")))).where(F.col("flights") >= frac * F.col("m")).agg(F.max("mon").alias("frontier"))


def operator_frontier(actuals: DataFrame, p: Params = Params()) -> DataFrame:
    """Per operator the last of all its months with at least frac of the median of its last months."""
    months = actuals.groupBy("operator", "mon").agg(F.count("*").alias("flights"))
    recent = months.withColumn("k", F.row_number().over(Window.partitionBy("operator").orderBy(F.col("mon").desc()))).where(F.col("k") <= p.frontier_window)
    return months.join(recent.groupBy("operator").agg(F.median("flights").alias("m")), "operator").where(F.col("flights") >= p.frontier_frac * F.col("m")).groupBy("operator").agg(F.max("mon").alias("frontier"))


def seasonal_fit(history: DataFrame, keys: list[str], k: float, value: str = "flights") -> DataFrame:
    """Twelve rows for each key: (cal, seas, n). Median of each calendar month over the mean of these medians, drawn to 1
    by k / (n + k), not below 0.1; months never seen are 1 with n = 0."""
    per = history.groupBy(*keys, F.month("mon").alias("cal")).agg(F.median(value).alias("med"), F.count("*").alias("n"))
    base = per.groupBy(*keys).agg(F.avg("med").alias("base")).withColumn("base", F.when(F.col("base") == 0, 1.0).otherwise(F.col("base")))
    grid = base.withColumn("cal", F.explode(F.sequence(F.lit(1), F.lit(12))))
    w = F.col("n") / (F.col("n") + F.lit(float(k)))
    seas = F.greatest(w * F.col("med") / F.col("base") + 1 - w, F.lit(0.10))
    return grid.join(per, [*keys, "cal"], "left").select(*keys, "cal", F.when(F.col("n").isNull(), 1.0).otherwise(seas).alias("seas"), F.coalesce("n", F.lit(0)).alias("n"))


def robust_level(history: DataFrame, seas: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:
    """Per key: level and base_fleet. Of the last level_window deseasonalised months those that are near complete (0.85 of
    the index quantile 0.75) give the median; with fewer than three the last level_l do."""
    s = seas.select(*keys, "cal", "seas")
    rows = history.withColumn("cal", F.month("mon")).join(s, [*keys, "cal"]).withColumn("des", F.col("flights") / F.col("seas"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mon").desc()))).where(F.col("k") <= max(p.level_window, p.level_l))
    whole = Window.partitionBy(*keys)
    inside = F.col("k") <= p.level_window
    ordered = F.array_sort(F.collect_list(F.when(inside, F.col("des"))).over(whole))
    n = F.size("sorted")
    rows = rows.withColumn("sorted", ordered).withColumn("ref", F.get("sorted", F.least(n - 1, F.floor(n * 0.75).cast("int"))))
    rows = rows.withColumn("good", inside & (n >= 3) & (F.col("des") >= p.level_complete_frac * F.col("ref"))).withColumn("some", F.max("good").over(whole))
    chosen = F.col("good") | (~F.col("some") & (F.col("k") <= p.level_l))
    out = rows.where(chosen).groupBy(*keys).agg(F.median("des").alias("level"), F.median("tails").alias("base_fleet"))
    return out.withColumn("base_fleet", F.when(F.col("base_fleet") == 0, 1.0).otherwise(F.col("base_fleet")))


GRAINS = ("sub_series", "master_series")


def keyed(actuals: DataFrame, p: Params = Params()) -> DataFrame:
    """Flights (rows with a date, from history_start on) with NA for unknown sub-series and master series."""
    rows = actuals.where(F.col("date").isNotNull() if p.history_start is None else F.col("date") >= F.lit(p.history_start))
    return rows.withColumns({c: key_or_na(F.col(c)) for c in GRAINS})


def history_to_frontier(actuals: DataFrame, key: str, p: Params = Params()) -> DataFrame:
    return monthly_history(actuals, key).join(operator_frontier(actuals, p), "operator").where("mon <= frontier AND flights > 0")


def fits(actuals: DataFrame, key: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(seasonal, level) of one grain, on the months up to each operator's frontier."""
    history = history_to_frontier(actuals, key, p)
    seas = seasonal_fit(history, ["operator", key], p.seas_k)
    return seas, robust_level(history, seas, ["operator", key], p)


def fit_two_grains(types: DataFrame, actuals: DataFrame, p: Params = Params()) -> DataFrame:
    """types: (operator, sub_series, master_series) of the fleet. Twelve rows each (grain, history_key, cal, seas, level,
    base_fleet): the fit of the sub-series, else, as for a type that was never flown, of its master series; none where
    neither has a history."""
    parts = []
    for key in GRAINS:
        seas, level = fits(actuals, key, p)
        rows = seas.join(level, ["operator", key])
        parts.append(rows.select("operator", F.lit(key).alias("grain"), F.col(key).alias("history_key"), "cal", "seas", "level", "base_fleet"))
    own = types.withColumn("history_key", F.col("sub_series")).join(parts[0], ["operator", "history_key"])
    rest = types.join(own.select("operator", "sub_series").distinct(), ["operator", "sub_series"], "left_anti")
    return own.unionByName(rest.withColumn("history_key", F.col("master_series")).join(parts[1], ["operator", "history_key"]))


def spans(last_facts: DataFrame, as_of: dt.date, p: Params = Params()) -> DataFrame:
    """last_facts: (operator, last_fact). The months from the day after to as_of's month in the horizon year, each with
    the days that count."""
    start = F.date_add("last_fact", 1)
    horizon = dt.date(as_of.year + p.horizon_years, as_of.month, 1)
    rows = last_facts.where(F.trunc(start, "month") <= F.lit(horizon)).withColumn("mon", F.explode(F.sequence(F.trunc(start, "month"), F.lit(horizon), F.expr("interval 1 month"))))
    dim = days_in_month(F.col("mon"))
    first = F.when(F.col("mon") == F.trunc(start, "month"), F.least(F.day(start), dim)).otherwise(1)
    last = F.when(F.col("mon") == F.lit(horizon), F.least(F.lit(as_of.day), dim)).otherwise(dim)
    return rows.select("operator", "mon", dim.alias("dim"), first.alias("start_day"), last.alias("end_day")).withColumn("span", F.greatest(F.lit(1), F.col("end_day") - F.col("start_day") + 1))


def flights_each(level: Column, seas: Column, base_fleet: Column, span: Column, dim: Column) -> Column:
    """Flights of one aircraft in a month, at least one; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(level * seas / base_fleet * (span / dim)).cast("int"))


def month_plan(fit: DataFrame, months: DataFrame) -> DataFrame:
    """fit: of the fleet's types. Per operator, sub-series and month: k, with the span's days and the share that they are
    of the month."""
    rows = months.withColumn("cal", F.month("mon")).join(fit, ["operator", "cal"]).withColumn("proration", F.col("span") / F.col("dim"))
    return rows.withColumn("k", flights_each(F.col("level"), F.col("seas"), F.col("base_fleet"), F.col("span"), F.col("dim")))


def plan_months(*plans: DataFrame) -> DataFrame:
    """The months that any of the plans has for an operator, each once."""
    parts = [p.select("operator", "mon") for p in plans]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
