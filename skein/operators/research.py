"""Forecast research for all carriers at once: anchor panel, backtests, priors, archetypes, conversions.

Refits without one month ("leave one out") are one more key: rows are joined to the months that are held out in turn and
the fit is grouped by that month as well. Only the monthly panel is multiplied, which is small whatever the flights are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_ordinal
from ..functions.scalars import block_hours, fleet_size_class, leg_class
from .fit import seasonal_fit
from .snapshots import latest_by, newest

SEAS_K, LEVEL_L, COVERAGE, MIN_MONTHS, GROWTH_CAP = 6.0, 3, 0.5, 3, 4.0
Z = {50: 0.6745, 80: 1.2816, 90: 1.6449}
Z80 = 1.2815515594
#: Settings of the recent-level forecast: its weight, and how fast disagreement with the backtest takes weight away.
SETTINGS = [("pure", 1.0, 0.0), ("gated", 0.8, 0.6)]


def anchor_panel(actuals: DataFrame) -> DataFrame:
    """Per carrier, sub-fleet and month: aircraft, active aircraft-days, flights, hours, km, medians and three ratios.

    Aircraft and their days are counted over one row an aircraft and month, and sums and medians by themselves: distinct
    counts beside medians would repeat every flight for each of them. actuals are read twice: they should be stored."""
    keys = ["carrier", "sf", "mon"]
    flights = actuals.select(F.col("operator").alias("carrier"), F.coalesce(F.nullif("master_series", F.lit("")), F.lit("NA")).alias("sf"), "mon", "reg", "date", "hours", "km", "seats")
    days = F.count_distinct("date") + F.max(F.col("date").isNull().cast("int"))  # an unknown day is one
    tails = flights.groupBy(*keys, "reg").agg(days.alias("days")).groupBy(*keys).agg(F.count("reg").alias("flown"), F.sum("days").alias("tail_days"))
    sums = flights.groupBy(*keys).agg(F.count("*").alias("cycles"), F.sum("hours").alias("block_hours"), F.sum("km").alias("sum_km"), F.median("km").alias("med_haul"), F.median("seats").alias("seats_med"))
    both = tails.unionByName(sums, allowMissingColumns=True)  # two rows a key, as a join would lose null keys
    rows = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("flown", "tail_days", "cycles", "block_hours", "sum_km", "med_haul", "seats_med")])
    return rows.withColumn("days_per_tail", F.try_divide("tail_days", "flown")).withColumn("cycles_per_day", F.try_divide("cycles", "tail_days")).withColumn("hours_per_day", F.try_divide("block_hours", "tail_days"))


def plateau(panel: DataFrame, n: int = 12) -> DataFrame:
    """Means of each sub-fleet's last months, and whether its legs are counted in cycles (short) or hours (long)."""
    last = panel.withColumn("k", F.row_number().over(Window.partitionBy("carrier", "sf").orderBy(F.col("mon").desc()))).where(F.col("k") <= n)
    out = last.groupBy("carrier", "sf").agg(F.avg("cycles").alias("cycles"), F.avg("flown").alias("flown"), F.avg("med_haul").alias("haul"), F.avg("cycles_per_day").alias("cycles_per_day"), F.avg("hours_per_day").alias("hours_per_day"))
    return out.withColumn("leg", leg_class(F.col("haul")))


def forward_deliveries(rows: DataFrame, cut: dt.date) -> DataFrame:
    """rows: (carrier, sf, reg, delivery_date). Distinct aircraft delivered after the cut, by month."""
    return rows.where(F.col("delivery_date") > F.lit(cut)).groupBy("carrier", "sf", F.trunc("delivery_date", "month").alias("deliv")).agg(F.count_distinct("reg").alias("n"))


def candidates(actuals: DataFrame, cut: dt.date, since: dt.date, n: int) -> DataFrame:
    """The n carriers with most flights of those with 24 months, four of them after the cut."""
    rows = actuals.where(F.col("mon") >= F.lit(since)).groupBy(F.col("operator").alias("carrier")).agg(F.count("*").alias("flights"), F.count_distinct("mon").alias("months"), F.count_distinct(F.when(F.col("mon") > F.lit(cut), F.col("mon"))).alias("held_out"))
    return rows.where("months >= 24 AND held_out >= 4").orderBy(F.col("flights").desc(), "carrier").limit(n)


def subfleet_fit(train: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(seasonal, level) of each key: the median of the last three deseasonalised months, the slope between the last two
    triples, rates per flight, n months, the last month."""
    flew = train.where("cycles > 0")
    seas = seasonal_fit(flew, keys, SEAS_K, "cycles")
    rows = flew.withColumn("cal", F.month("mon")).join(seas.select(*keys, "cal", "seas"), [*keys, "cal"]).withColumn("des", F.col("cycles") / F.col("seas"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mon").desc())))
    last, before = F.median(F.when(F.col("k") <= 3, F.col("des"))), F.median(F.when(F.col("k").between(4, 6), F.col("des")))
    level = rows.groupBy(*keys).agg(
        F.median(F.when(F.col("k") <= LEVEL_L, F.col("des"))).alias("level"), F.when(F.count("*") >= 6, (last - before) / 3.0).otherwise(0.0).alias("slope"), F.count("*").alias("months"),
        F.avg(F.when(F.col("sum_km") != 0, F.col("sum_km") / F.col("cycles"))).alias("km_per_flight"), F.median(F.when(F.col("seats_med") != 0, F.col("seats_med"))).alias("seats"),
        F.coalesce(F.median(F.when((F.col("k") <= 3) & (F.col("flown") > 0), F.col("flown"))), F.lit(0.0)).alias("base_fleet"),
        F.max("mon").alias("as_of"),
    )
    return seas, level


def _growth(level: DataFrame, deliveries: DataFrame | None, months: DataFrame) -> DataFrame:
    """months: (carrier, sf, mon). growth: 1, or the fleet with deliveries up to the month over the base fleet, capped."""
    if deliveries is None:
        return months.withColumn("growth", F.lit(1.0))
    due = months.join(deliveries, ["carrier", "sf"]).where("deliv <= mon").groupBy("carrier", "sf", "mon").agg(F.sum("n").alias("due"))
    rows = months.join(due, ["carrier", "sf", "mon"], "left").join(level.select("carrier", "sf", "base_fleet"), ["carrier", "sf"], "left")
    grown = F.least((F.col("base_fleet") + F.col("due")) / F.col("base_fleet"), F.lit(GROWTH_CAP))
    return rows.withColumn("growth", F.coalesce(F.when(F.col("base_fleet") > 0, grown), F.lit(1.0))).drop("due", "base_fleet")


def _projected(phi: float) -> Column:
    """The level, moved by the slope as far as a trend damped by phi a month goes beyond the last month; never below 0."""
    if not 0 <= phi < 1:
        raise ValueError("phi must be from 0 to below 1")
    ahead = F.greatest(month_ordinal(F.col("mon")) - month_ordinal(F.col("as_of")), F.lit(0))
    trend = F.col("slope") * (1 - F.pow(F.lit(float(phi)), ahead)) / (1 - phi) if phi else F.lit(0.0)
    return F.greatest(F.col("level") + trend, F.lit(0.0))


def _hats(panel: DataFrame, seas: DataFrame, level: DataFrame, growth: DataFrame, keys: list[str], phi: float = 0.0) -> DataFrame:
    """Per carrier and month (and what else is in keys) the sum over the sub-fleets that flew in it."""
    cells = panel.select("carrier", "sf", "mon").join(growth, ["carrier", "sf", "mon"]).withColumn("cal", F.month("mon"))
    rows = cells.join(level.select(*keys, "level", "slope", "as_of"), ["carrier", "sf"]).join(seas.select(*keys, "cal", "seas"), [*keys, "cal"])
    extra = [k for k in keys if k not in ("carrier", "sf")]
    return rows.groupBy("carrier", "mon", *extra).agg(F.sum(_projected(phi) * F.col("seas") * F.col("growth")).alias("hat"))


def _actual(panel: DataFrame) -> DataFrame:
    return panel.groupBy("carrier", "mon").agg(F.sum("cycles").alias("actual"), F.sum("flown").alias("flown"))


def _without_each_month(train: DataFrame) -> DataFrame:
    """The training rows once for each month of their carrier, without that month (held)."""
    months = train.select("carrier", F.col("mon").alias("held")).distinct()
    return train.join(months, "carrier").where("mon <> held")


def _log_stats(ratios: DataFrame) -> DataFrame:
    """ratios: (carrier, ratio). mu and sigma of the logarithms; 0 and 0.20 for fewer than two, sigma at least 0.05."""
    logs = ratios.where("ratio > 0").withColumn("l", F.log("ratio")).groupBy("carrier").agg(F.count("*").alias("c"), F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    return logs.select("carrier", F.when(F.col("c") >= 2, F.col("m")).otherwise(0.0).alias("mu"), F.when(F.col("c") >= 2, F.greatest("s", F.lit(0.05))).otherwise(0.20).alias("sigma"))


def _horizon(cut: dt.date) -> Column:
    return F.greatest(F.lit(1), month_ordinal(F.col("mon")) - (cut.year * 12 + cut.month))


def _gate(actual: DataFrame, cut: dt.date) -> DataFrame:
    """Months after the cut with whether they hold at least half of the median training month's flights."""
    base = actual.where((F.col("mon") <= F.lit(cut)) & (F.col("actual") > 0)).groupBy("carrier").agg((F.median("actual") * COVERAGE).alias("least"))
    return actual.where(F.col("mon") > F.lit(cut)).join(base, "carrier", "left").withColumn("valid", F.coalesce(F.col("actual") >= F.col("least"), F.lit(True)))


def backtest(panel: DataFrame, cut: dt.date, deliveries: DataFrame | None = None, phi: float = 0.0) -> DataFrame:
    """Per carrier and held-out month: actual, hat, error in per cent, the 80 % band, valid, inside. With phi above 0 levels
    follow a damped trend."""
    train = panel.where(F.col("mon") <= F.lit(cut))
    seas, level = subfleet_fit(train, ["carrier", "sf"])
    growth = _growth(level, deliveries, panel.select("carrier", "sf", "mon"))
    hats, actual = _hats(panel, seas, level, growth, ["carrier", "sf"], phi), _actual(panel)
    loo = _without_each_month(train)
    s1, l1 = subfleet_fit(loo, ["carrier", "sf", "held"])
    out = _hats(train, s1, l1, growth, ["carrier", "sf", "held"], phi).where("mon = held")
    ratios = out.join(actual, ["carrier", "mon"]).where("actual > 0 AND hat > 0").select("carrier", (F.col("actual") / F.col("hat")).alias("ratio"))
    rows = _gate(actual, cut).join(hats, ["carrier", "mon"]).where("hat > 0").join(_log_stats(ratios), "carrier", "left")
    width = F.lit(Z80) * F.coalesce("sigma", F.lit(0.20)) * F.sqrt(_horizon(cut))
    mu = F.coalesce("mu", F.lit(0.0))
    rows = rows.withColumn("err", (F.col("hat") - F.col("actual")) / F.col("actual") * 100).withColumn("lo", F.col("hat") * F.exp(mu - width)).withColumn("hi", F.col("hat") * F.exp(mu + width))
    return rows.withColumn("inside", (F.col("lo") <= F.col("actual")) & (F.col("actual") <= F.col("hi"))).select("carrier", "mon", "actual", "flown", "hat", "err", "lo", "hi", "inside", "valid")


def backtest_metrics(detail: DataFrame, panel: DataFrame, cut: dt.date) -> DataFrame:
    """Per carrier: MAPE, bias, coverage, months used and left out, fleet growth against the last training year."""
    good = F.col("valid")
    rows = detail.groupBy("carrier").agg(F.avg(F.when(good, F.abs("err"))).alias("mape"), F.avg(F.when(good, F.col("err"))).alias("bias"), F.avg(F.when(good, F.col("inside").cast("int"))).alias("coverage"), F.count(F.when(good, 1)).alias("n_holdout"), F.count(F.when(~good, 1)).alias("n_excluded"), F.avg(F.when(good, F.col("flown"))).alias("_held"))
    train = _actual(panel).where(F.col("mon") <= F.lit(cut)).withColumn("k", F.row_number().over(Window.partitionBy("carrier").orderBy(F.col("mon").desc()))).where("k <= 12")
    rows = rows.join(train.groupBy("carrier").agg(F.avg("flown").alias("_train")), "carrier", "left")
    return rows.withColumn("n_growth", F.try_divide("_held", "_train")).withColumn("validatable", F.col("n_holdout") >= MIN_MONTHS).drop("_held", "_train")


def forward(panel: DataFrame, cut: dt.date, launch: dt.date, load_factor: float = 0.8, phi: float = 0.0) -> DataFrame:
    """Per carrier and month after the cut, up to the launch's month two years on: flights with their 80 % band, km, block
    hours and passengers.

    All sub-fleets that have a fit count, whether they flew lately or not. The band comes from the training months
    themselves (actual over hat of the same fits) and widens with the root of the months since the cut.
    """
    end = dt.date(launch.year + 2, launch.month, 1)
    if (end.year, end.month) <= (cut.year, cut.month):
        raise ValueError("the cut must be before the last month")
    keys = ["carrier", "sf"]
    train = panel.where(F.col("mon") <= F.lit(cut))
    seas, level = subfleet_fit(train, keys)
    cells = train.select("carrier", "mon").distinct().join(level.select(*keys), "carrier")
    past = _hats(cells, seas, level, cells.withColumn("growth", F.lit(1.0)), keys, phi)
    ratios = past.join(_actual(train), ["carrier", "mon"]).where("actual > 0 AND hat > 0").select("carrier", (F.col("actual") / F.col("hat")).alias("ratio"))
    months = F.sequence(F.add_months(F.lit(cut.replace(day=1)), 1), F.lit(end), F.expr("interval 1 month"))
    ahead = level.withColumn("mon", F.explode(months)).withColumn("cal", F.month("mon")).join(seas.select(*keys, "cal", "seas"), [*keys, "cal"])
    each = ahead.withColumn("f", _projected(phi) * F.col("seas")).withColumn("per", F.coalesce("km_per_flight", F.lit(0.0)))
    total = each.groupBy("carrier", "mon").agg(
        F.sum("f").alias("flights"), F.sum(F.col("f") * F.col("per")).alias("km"), F.sum(F.col("f") * block_hours(F.col("per"))).alias("hours"),
        F.sum(F.col("f") * F.coalesce("seats", F.lit(0.0)) * load_factor).alias("pax"),
    )
    rows = total.join(_log_stats(ratios), "carrier", "left")
    width, mu = F.lit(Z80) * F.coalesce("sigma", F.lit(0.20)) * F.sqrt(_horizon(cut)), F.coalesce("mu", F.lit(0.0))
    return rows.select("carrier", "mon", "flights", (F.col("flights") * F.exp(mu - width)).alias("lo"), (F.col("flights") * F.exp(mu + width)).alias("hi"), "km", "hours", "pax")


def growth_read(metrics: DataFrame) -> DataFrame:
    """One row over the carriers that can be validated: their number, the correlation of growth and bias (null below three
    or without variance), and for those that grew, stayed (within 5 %) and shrank the number and the means of bias, MAPE
    and coverage."""
    g = F.col("n_growth")
    groups = {"grew": g > 1.05, "stable": g.between(0.95, 1.05), "shrank": g < 0.95}
    spread = F.stddev_pop("n_growth") * F.stddev_pop("bias")
    r = F.when(F.count("*") >= 3, F.try_divide(F.covar_pop("n_growth", "bias"), spread)).alias("r")
    means = [F.avg(F.when(c, F.col(m))).alias(f"{name}_{m}") for name, c in groups.items() for m in ("bias", "mape", "coverage")]
    return metrics.where("validatable AND n_growth IS NOT NULL").agg(F.count("*").alias("carriers"), r, *[F.count(F.when(c, 1)).alias(name) for name, c in groups.items()], *means)


def seasonal_prior(seas: DataFrame, level: DataFrame) -> DataFrame:
    """Per carrier, sub-fleet and calendar month the mean factor of all OTHER carriers, weighted by their months."""
    rows = seas.drop("n").join(level.select("carrier", "sf", F.col("months").alias("n")), ["carrier", "sf"])
    all_ = rows.groupBy("sf", "cal").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("seas")).alias("ws"))
    own = rows.join(all_, ["sf", "cal"])
    return own.where("w - n > 0").select("carrier", "sf", "cal", ((F.col("ws") - F.col("n") * F.col("seas")) / (F.col("w") - F.col("n"))).alias("prior"))


def shrunk(seas: DataFrame, level: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Own factors drawn to the prior by n / (n + 6)."""
    rows = seas.join(level.select(*keys, "months"), keys).join(prior, ["carrier", "sf", "cal"], "left")
    w = F.col("months") / (F.col("months") + SEAS_K)
    return rows.select(*keys, "cal", F.when(F.col("prior").isNotNull(), w * F.col("seas") + (1 - w) * F.col("prior")).otherwise(F.col("seas")).alias("seas"))


def loco(panel: DataFrame, cut: dt.date) -> DataFrame:
    """Leave one carrier out: per carrier and valid held-out month actual, hat, error and whether bands of 50, 80 and 90 %
    hold the actual. Carriers need three valid months."""
    actual = _actual(panel)
    valid = _gate(actual, cut).where("valid")
    enough = valid.groupBy("carrier").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_MONTHS).select("carrier")
    panel = panel.join(enough, "carrier", "left_semi")
    train = panel.where(F.col("mon") <= F.lit(cut))
    seas, level = subfleet_fit(train, ["carrier", "sf"])
    prior = seasonal_prior(seas, level)
    flat = panel.select("carrier", "sf", "mon").withColumn("growth", F.lit(1.0))
    hats = _hats(panel, shrunk(seas, level, prior, ["carrier", "sf"]), level, flat, ["carrier", "sf"])
    s1, l1 = subfleet_fit(_without_each_month(train), ["carrier", "sf", "held"])
    own = _hats(train, shrunk(s1, l1, prior, ["carrier", "sf", "held"]), l1, flat, ["carrier", "sf", "held"]).where("mon = held")
    stats = _log_stats(own.join(actual, ["carrier", "mon"]).where("actual > 0 AND hat > 0").select("carrier", (F.col("actual") / F.col("hat")).alias("ratio")))
    rows = valid.join(hats, ["carrier", "mon"]).where("hat > 0").join(stats, "carrier", "left")
    sigma = F.coalesce("sigma", F.lit(0.20)) * F.sqrt(_horizon(cut))
    gap = F.log(F.col("actual") / F.col("hat")) - F.coalesce("mu", F.lit(0.0))
    return rows.select("carrier", "mon", "actual", "hat", ((F.col("hat") - F.col("actual")) / F.col("actual") * 100).alias("err"), *[(F.abs(gap) <= z * sigma).alias(f"in{k}") for k, z in Z.items()])


def reliability(detail: DataFrame) -> DataFrame:
    """Nominal against empirical coverage over all carrier-months."""
    levels = F.array(*[F.struct(F.lit(k).alias("nominal"), F.col(f"in{k}").cast("int").alias("hit")) for k in Z])
    return detail.select(F.explode(levels).alias("x")).groupBy("x.nominal").agg(F.avg("x.hit").alias("empirical"), F.count("*").alias("months"))


def carrier_reliability(detail: DataFrame) -> DataFrame:
    """Per carrier: months, MAPE, bias and the share of months inside the 80 % band."""
    return detail.groupBy("carrier").agg(F.count("*").alias("months"), F.avg(F.abs("err")).alias("mape"), F.avg("err").alias("bias"), F.avg(F.col("in80").cast("int")).alias("cov80"))


def ondemand_reliability(panel: DataFrame, buckets: DataFrame, cut: dt.date) -> DataFrame:
    """The carriers that fly on demand, left out one by one among themselves: per size of fleet their number and the
    medians of MAPE and of coverage by the 80 % band."""
    own = buckets.where("bucket = 'ondemand'").select("carrier", "size")
    rows = carrier_reliability(loco(panel.join(own.select("carrier"), "carrier", "left_semi"), cut)).join(own, "carrier")
    return rows.groupBy("size").agg(F.count("*").alias("carriers"), F.median("mape").alias("mape"), F.median("cov80").alias("cov80"))


def archetype_features(actuals: DataFrame, least_flights: int = 1500, least_months: int = 12) -> DataFrame:
    """Per carrier: flights per route, the share of its ten largest routes, flights per aircraft and month (all aircraft
    times all months), aircraft."""
    routes = actuals.groupBy(F.col("operator").alias("carrier"), "origin", "dest").agg(F.count("*").alias("f"))
    top = routes.withColumn("k", F.row_number().over(Window.partitionBy("carrier").orderBy(F.col("f").desc(), "origin", "dest"))).groupBy("carrier").agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("k") <= 10, F.col("f"))).alias("top10"))
    all_ = actuals.groupBy(F.col("operator").alias("carrier")).agg(F.count("*").alias("flights"), F.count_distinct("mon").alias("months"), F.count_distinct("reg").alias("tails"))
    rows = all_.where((F.col("flights") >= least_flights) & (F.col("months") >= least_months)).join(top, "carrier")
    return rows.select("carrier", "tails", (F.col("flights") / F.col("pairs")).alias("per_pair"), (F.col("top10") / F.col("flights")).alias("top10_share"), (F.col("flights") / (F.col("tails") * F.col("months"))).alias("per_tail_month"))


def archetype(features: DataFrame) -> DataFrame:
    """Score (sum of z-values) and bucket: carriers below the widest gap in the middle of the sorted scores fly on demand.
    The table has a row for each carrier."""
    raw = features.withColumn("a", F.log("per_pair")).withColumn("b", F.col("top10_share")).withColumn("c", F.log("per_tail_month"))
    stats = raw.agg(*[f(c).alias(f"{c}_{n}") for c in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.coalesce(F.col(f"{c}_s"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{c}_s"))
    scored = raw.crossJoin(F.broadcast(stats)).select("carrier", "tails", (z("a") + z("b") + z("c")).alias("score"))
    return scored.crossJoin(F.broadcast(valley(scored))).select("carrier", "tails", "score", F.when(F.col("score") < F.col("threshold"), "ondemand").otherwise("schedule").alias("bucket"), fleet_size_class(F.col("tails")).alias("size"))


def valley(scored: DataFrame) -> DataFrame:
    """One row: the middle of the widest step between neighbours, from 15 to 70 per cent of the sorted scores; the first
    of equal ones. 0 where there is no step."""
    w = Window.partitionBy(F.lit(0)).orderBy("score", "carrier")
    rows = scored.select("score", (F.row_number().over(w) - 1).alias("i"), F.lead("score").over(w).alias("next"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    inside = rows.where((F.col("i") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.15))) & (F.col("i") < F.least(F.col("n") - 1, F.floor(F.col("n") * 0.7))) & F.col("next").isNotNull())
    return inside.agg(F.max(F.struct((F.col("next") - F.col("score")).alias("gap"), (-F.col("i")).alias("first"), ((F.col("next") + F.col("score")) / 2).alias("threshold"))).alias("m")).select(F.coalesce("m.threshold", F.lit(0.0)).alias("threshold"))


def monthly_series(snapshots: DataFrame, actuals: DataFrame, since: dt.date) -> DataFrame:
    """Per carrier and month the aircraft in service (by each registration's newest row of the month) and the flights; a
    month that has only one of them has null for the other."""
    rows = latest_by(snapshots.where(F.col("period") >= F.lit(since)), ["operator", "reg", "period"], newest()).where("status = 'In Service'")
    fleet = rows.groupBy(F.col("operator").alias("carrier"), F.col("period").alias("mon")).agg(F.count("*").alias("in_service"))
    flown = actuals.where(F.col("mon") >= F.lit(since)).groupBy(F.col("operator").alias("carrier"), "mon").agg(F.count("*").alias("flights"))
    return fleet.join(flown, ["carrier", "mon"], "full")


def recent_level(series: DataFrame, cut: dt.date) -> DataFrame:
    """series: (carrier, mon, flights). Per carrier: recent and flat level of up to three months within six of the cut
    (else the last one), sigma from the median deviation, span. Seasonal factors by seasonal_fit with k = 6."""
    rows = series.where((F.col("mon") <= F.lit(cut)) & F.col("flights").isNotNull()).withColumn("cal", F.month("mon")).withColumn("i", month_ordinal(F.col("mon")))
    rows = rows.join(seasonal_fit(rows, ["carrier"], SEAS_K).select("carrier", "cal", "seas"), ["carrier", "cal"])
    end = cut.year * 12 + cut.month
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("carrier").orderBy(F.col("i").desc()))).withColumn("near", (end - F.col("i") <= 6) & (F.col("k") <= 3))
    rows = rows.withColumn("near", F.col("near") | ((F.col("k") == 1) & ~F.max("near").over(Window.partitionBy("carrier")))).withColumn("l", F.log(F.greatest(F.col("flights") / F.col("seas"), F.lit(0.5))))
    rows = rows.withColumn("d", F.abs(F.col("l") - F.median("l").over(Window.partitionBy("carrier"))))
    out = rows.groupBy("carrier").agg(F.median(F.when(F.col("near"), F.col("flights"))).alias("flat_level"), F.median(F.when(F.col("near"), F.col("flights") / F.col("seas"))).alias("recent_level"), (F.max("i") - F.min("i") + 1).alias("span"), F.count("*").alias("c"), F.median("d").alias("mad"))
    sigma = F.when(F.col("c") >= 3, F.least(F.greatest(1.4826 * F.col("mad"), F.lit(0.30)), F.lit(1.10))).otherwise(0.30)
    return out.withColumn("sigma", sigma).withColumn("low_confidence", F.col("sigma") > 0.60).drop("c", "mad")


def _recent_and_hat(series: DataFrame, detail: DataFrame, cut: dt.date) -> DataFrame:
    """A backtest's valid months, numbered, with the recent-level forecast (own) and the first month's hat (anchor)."""
    level = recent_level(series, cut)
    seas = seasonal_fit(series.where((F.col("mon") <= F.lit(cut)) & F.col("flights").isNotNull()), ["carrier"], SEAS_K).select("carrier", "cal", "seas")
    order = Window.partitionBy("carrier").orderBy("mon")
    rows = detail.where("valid").select("carrier", "mon", "actual", "hat", F.row_number().over(order).alias("h"), F.first("hat").over(order).alias("anchor")).withColumn("cal", F.month("mon"))
    return rows.join(level, "carrier").join(seas, ["carrier", "cal"]).withColumn("own", F.when(F.col("span") < 24, F.col("flat_level")).otherwise(F.col("recent_level") * F.col("seas")))


def _gated(rows: DataFrame, w0: Column, gate: Column) -> DataFrame:
    """yhat: own, drawn to the hat the more own and anchor differ; lo and hi: the 80 % band."""
    w = w0 * F.exp(-gate * F.abs(F.log(F.col("own") / F.col("anchor"))))
    rows = rows.withColumn("yhat", w * F.col("own") + (1 - w) * F.col("hat"))
    width = Z80 * F.col("sigma") * F.sqrt("h")
    return rows.withColumn("lo", F.col("yhat") * F.exp(-width)).withColumn("hi", F.col("yhat") * F.exp(width))


def evaluate_recent(series: DataFrame, detail: DataFrame, cut: dt.date, w0: float, gate: float) -> DataFrame:
    """The recent-level forecast on a backtest's valid months, gated toward its hat where the two disagree."""
    rows = _gated(_recent_and_hat(series, detail, cut), F.lit(w0), F.lit(gate))
    return rows.select("carrier", "mon", "actual", "yhat", "lo", "hi", "low_confidence")


def evaluate_settings(series: DataFrame, detail: DataFrame, metrics: DataFrame, buckets: DataFrame, cut: dt.date, settings: list[tuple[str, float, float]] = SETTINGS) -> DataFrame:
    """Per setting (name, w0, gate) and validatable carrier that flies on demand: MAPE, the backtest's MAPE (anchor),
    coverage by the 80 % band, size of fleet, and whether its recent activity is too uneven to trust."""
    who = buckets.where("bucket = 'ondemand'").select("carrier", "tails", "size").join(metrics.where("validatable").select("carrier", F.col("mape").alias("anchor_mape")), "carrier")
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(float(w)).alias("w0"), F.lit(float(g)).alias("gate")) for n, w, g in settings]))
    rows = _recent_and_hat(series, detail.join(who.select("carrier"), "carrier", "left_semi"), cut).withColumn("s", table).select("*", "s.*")
    rows = _gated(rows, F.col("w0"), F.col("gate"))
    held = (F.col("lo") <= F.col("actual")) & (F.col("actual") <= F.col("hi"))
    out = rows.groupBy("setting", "carrier").agg(F.avg(F.abs(F.col("yhat") - F.col("actual")) / F.col("actual") * 100).alias("mape"), F.avg(held.cast("int")).alias("cov80"), F.max("low_confidence").alias("low_confidence"))
    return out.join(who, "carrier").select("setting", "carrier", "tails", "size", "mape", "anchor_mape", "cov80", "low_confidence")


def settings_summary(rows: DataFrame) -> DataFrame:
    """Per setting: carriers, those that beat the backtest, and of small fleets the median MAPE, the backtest's and the mean
    coverage (null where no fleet is small)."""
    small = F.col("size") == "small"
    of = lambda c: F.when(small, F.col(c))
    return rows.groupBy("setting").agg(
        F.count("*").alias("carriers"), F.count(F.when(F.col("mape") < F.col("anchor_mape"), 1)).alias("beats"), F.median(of("mape")).alias("mape"), F.median(of("anchor_mape")).alias("anchor_mape"), F.avg(of("cov80")).alias("cov80")
    )


def convert_metrics(panel: DataFrame, cut: dt.date, load_factor: float = 0.8) -> DataFrame:
    """Per carrier and valid held-out month: flights, km (seasonal and flat), block hours and passengers forecast, and the
    actual flights and km. Km per flight is drawn from its calendar month's mean to the flat mean by n / (n + 4)."""
    train = panel.where(F.col("mon") <= F.lit(cut))
    seas, level = subfleet_fit(train, ["carrier", "sf"])
    per = train.where("sum_km <> 0 AND cycles > 0").groupBy("carrier", "sf", F.month("mon").alias("cal")).agg(F.avg(F.col("sum_km") / F.col("cycles")).alias("s"), F.count("*").alias("n"))
    cells = panel.where(F.col("mon") > F.lit(cut)).select("carrier", "sf", "mon", F.month("mon").alias("cal")).join(level, ["carrier", "sf"]).join(seas.drop("n"), ["carrier", "sf", "cal"]).join(per, ["carrier", "sf", "cal"], "left")
    w = F.col("n") / (F.col("n") + 4.0)
    flat = F.coalesce("km_per_flight", F.lit(0.0))
    km = F.coalesce(w * F.col("s") + (1 - w) * F.col("km_per_flight"), flat)
    hat = F.greatest(F.col("level"), F.lit(0.0)) * F.col("seas")
    rows = cells.withColumn("f", hat).withColumn("km1", km).groupBy("carrier", "mon").agg(F.sum("f").alias("flights_hat"), F.sum(F.col("f") * F.col("km1")).alias("km_hat"), F.sum(F.col("f") * flat).alias("km_hat_flat"), F.sum(F.col("f") * block_hours(F.col("km1"))).alias("hours_hat"), F.sum(F.col("f") * F.coalesce("seats", F.lit(0.0)) * load_factor).alias("pax_hat"))
    actual = panel.groupBy("carrier", "mon").agg(F.sum("sum_km").alias("km_actual"))
    return _gate(_actual(panel), cut).where("valid").join(rows, ["carrier", "mon"]).join(actual, ["carrier", "mon"]).where("flights_hat > 0").select("carrier", "mon", "flights_hat", "km_hat", "km_hat_flat", "hours_hat", "pax_hat", F.col("actual").alias("flights_actual"), "km_actual")


def conversion_errors(rows: DataFrame) -> DataFrame:
    """rows: see convert_metrics. Per carrier the months and the mean absolute error in per cent of flights, of km, and of km
    by the flat mean; months without an actual value don't count."""
    error = lambda hat, actual: F.avg(F.when(F.col(actual) != 0, F.abs(F.col(hat) - F.col(actual)) / F.col(actual) * 100))
    return rows.groupBy("carrier").agg(
        F.count("*").alias("months"), error("flights_hat", "flights_actual").alias("flights_mape"), error("km_hat", "km_actual").alias("km_mape"), error("km_hat_flat", "km_actual").alias("km_mape_flat")
    )
