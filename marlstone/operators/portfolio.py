"""Long-short spreads, turnover, cost, concentration, folds and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import nn


def positions(scored: DataFrame, label: str, *, long_share: float = 0.2, short_share: float = 0.2, top_n: int | None = None, bottom_n: int | None = None, rank_weighted: bool = False) -> DataFrame:
    """decision_date, ticker, sector, leg, weight, ret, universe of the dates whose legs don't overlap.

    Names go by score, then ticker, descending. Weights are equal or by rank
    and add up to one within a leg.
    """
    w = Window.partitionBy("decision_date")
    u = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()).withColumn("universe", F.count("*").over(w)).withColumn("flat", F.max("score").over(w) == F.min("score").over(w))
    down = w.orderBy(F.desc("score"), F.desc("ticker"))
    n_long = F.lit(top_n) if top_n is not None else F.greatest(F.lit(1), F.floor(F.col("universe") * long_share).cast("int"))
    n_short = F.lit(bottom_n) if bottom_n is not None else F.greatest(F.lit(1), F.floor(F.col("universe") * short_share).cast("int"))
    u = u.withColumn("rn", F.row_number().over(down)).withColumns({"n_long": n_long, "n_short": n_short})
    u = u.where((F.col("universe") >= 2) & ~F.col("flat") & (F.col("n_long") >= 1) & (F.col("n_short") >= 1) & (F.col("n_long") + F.col("n_short") <= F.col("universe")))
    up = F.col("universe") - F.col("rn") + 1
    leg = F.when(F.col("rn") <= F.col("n_long"), "long").when(up <= F.col("n_short"), "short")
    p = u.withColumn("leg", leg).where("leg IS NOT NULL")
    place, size = F.when(F.col("leg") == "long", F.col("rn")).otherwise(up), F.when(F.col("leg") == "long", F.col("n_long")).otherwise(F.col("n_short"))
    weight = (size - place + 1) / (size * (size + 1) / 2.0) if rank_weighted else F.lit(1.0) / size
    return p.select("decision_date", "ticker", "sector", "leg", weight.alias("weight"), F.col(label).alias("ret"), "universe")


def date_spreads(scored: DataFrame, label: str, **how) -> DataFrame:
    """decision_date, status, legs' returns and their difference, for every date."""
    u = scored.groupBy("decision_date").agg(F.sum((F.col("score").isNotNull() & F.col(label).isNotNull()).cast("int")).alias("universe"), F.max(F.when(F.col(label).isNotNull(), F.col("score"))).alias("hi"), F.min(F.when(F.col(label).isNotNull(), F.col("score"))).alias("lo"))
    leg = lambda k, x: F.sum(F.when(F.col("leg") == k, x))
    p = positions(scored, label, **how).groupBy("decision_date").agg(leg("long", F.col("weight") * F.col("ret")).alias("long_return"), leg("short", F.col("weight") * F.col("ret")).alias("short_return"), leg("long", F.lit(1)).alias("n_long"), leg("short", F.lit(1)).alias("n_short"))
    d = u.join(p, "decision_date", "left")
    status = F.when(F.col("n_long").isNotNull(), "ok").when((F.col("universe") >= 2) & (F.col("hi") == F.col("lo")), "constant_predictions").otherwise("insufficient_names")
    return d.select("decision_date", status.alias("status"), "universe", F.coalesce("n_long", F.lit(0)).alias("n_long"), F.coalesce("n_short", F.lit(0)).alias("n_short"), "long_return", "short_return", (F.col("long_return") - F.col("short_return")).alias("spread"))


def equity_curve(spreads: DataFrame) -> DataFrame:
    """decision_date, equity, peak, drawdown by compounding; one row per date, so one ordered pass."""
    w = Window.orderBy("decision_date").rowsBetween(Window.unboundedPreceding, 0)
    e = spreads.where("spread IS NOT NULL").withColumn("equity", F.product(1 + F.col("spread") / 100).over(w))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return e.select("decision_date", "equity", "peak", ((F.col("equity") / nn("peak") - 1) * 100).alias("drawdown"))


def spread_summary(spreads: DataFrame, periods: float = 12.0) -> DataFrame:
    s = spreads.where("spread IS NOT NULL")
    sd = F.stddev_samp("spread")
    best = lambda sign: F.min_by(F.col("decision_date"), F.struct(sign * F.col("spread"), F.col("decision_date")))
    return s.agg(F.count("*").alias("n_periods"), F.avg("spread").alias("mean_spread"), sd.alias("std_spread"), (F.avg("spread") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe_like"), F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate"), best(F.lit(1)).alias("worst_period"), best(F.lit(-1)).alias("best_period"))


def turnover(pos: DataFrame) -> DataFrame:
    """decision_date, long, short and total one-sided turnover against the date before; not for the first."""
    dates = pos.select("decision_date").distinct().withColumn("next_date", F.lead("decision_date").over(Window.orderBy("decision_date")))
    now = pos.select("decision_date", "ticker", "leg", "weight")
    before = now.join(F.broadcast(dates.where("next_date IS NOT NULL")), "decision_date").select(F.col("next_date").alias("decision_date"), "ticker", "leg", F.col("weight").alias("was"))
    j = now.join(dates.select(F.col("next_date").alias("decision_date")).where("decision_date IS NOT NULL"), "decision_date", "left_semi").join(before, ["decision_date", "ticker", "leg"], "full_outer")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) / 2
    t = j.groupBy("decision_date").agg(*[F.sum(F.when(F.col("leg") == k, change).otherwise(0.0)).alias(f"{k}_turnover") for k in ("long", "short")])
    return t.withColumn("turnover", F.col("long_turnover") + F.col("short_turnover"))


def net_of_cost(spreads: DataFrame, turn: DataFrame, bps: float) -> DataFrame:
    """decision_date, gross, cost, net; the first date costs nothing."""
    cost = F.coalesce("turnover", F.lit(0.0)) * bps / 100
    return spreads.where("spread IS NOT NULL").join(turn.select("decision_date", "turnover"), "decision_date", "left").select("decision_date", F.col("spread").alias("gross"), cost.alias("cost"), (F.col("spread") - cost).alias("net"))


def concentration(pos: DataFrame) -> DataFrame:
    """decision_date, leg, hhi, effective_n, top_weight."""
    return pos.groupBy("decision_date", "leg").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max("weight").alias("top_weight")).withColumn("effective_n", 1 / nn("hhi"))


def sector_exposure(pos: DataFrame) -> DataFrame:
    """leg, sector, exposure: mean weight over all dates; a sector that is absent counts zero."""
    n = pos.agg(F.countDistinct("decision_date").alias("n_dates"))
    return pos.groupBy("leg", "sector").agg(F.sum("weight").alias("w")).crossJoin(F.broadcast(n)).select("leg", "sector", (F.col("w") / F.col("n_dates")).alias("exposure"))


def leg_excess(pos: DataFrame, scored: DataFrame, label: str) -> DataFrame:
    """decision_date, leg, excess over the universe's mean and over sector means (universe where a sector has none)."""
    s = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull())
    uni = s.groupBy("decision_date").agg(F.avg(label).alias("u"))
    sec = s.where("sector IS NOT NULL").groupBy("decision_date", "sector").agg(F.avg(label).alias("s"))
    j = pos.join(uni, "decision_date").join(sec, ["decision_date", "sector"], "left")
    return j.groupBy("decision_date", "leg").agg((F.sum(F.col("weight") * (F.col("ret") - F.col("u")))).alias("excess_universe"), F.sum(F.col("weight") * (F.col("ret") - F.coalesce("s", "u"))).alias("excess_sector"))


def walk_forward(spark, dates: DataFrame, *, min_train: int, test_size: int = 1, rolling: bool = False) -> DataFrame:
    """fold, role, decision_date. Folds follow from the dates' order; each takes its training dates by their number."""
    d = dates.select("decision_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("decision_date")) - 1)
    n = d.agg(F.count("*").alias("n"))
    folds = n.select(F.explode(F.when(F.col("n") >= min_train + test_size, F.sequence(F.lit(0), F.floor((F.col("n") - min_train - test_size) / test_size).cast("int")))).alias("fold"))
    start = F.lit(min_train) + F.col("fold") * test_size
    low = start - min_train if rolling else F.lit(0)
    j = d.join(F.broadcast(folds), (F.col("i") >= low) & (F.col("i") < start + test_size))
    return j.select("fold", F.when(F.col("i") < start, "train").otherwise("test").alias("role"), "decision_date")


def purge_embargo(train: DataFrame, test_start, test_end, embargo_days: int) -> DataFrame:
    """train rows (start, end) with outcome kept, purged (overlap with the test window) or embargoed."""
    a, b = F.lit(test_start).cast("date"), F.lit(test_end).cast("date")
    over = (F.col("start") <= b) & (F.col("end") >= a)
    late = (F.col("start") > b) & (F.col("start") <= F.date_add(b, embargo_days))
    return train.withColumn("outcome", F.when(over, "purged").when(late, "embargoed").otherwise("kept"))


def monitor(series: DataFrame, window: int = 3, z: float = 2.0) -> DataFrame:
    """metric, date, value, mean, std, z and a flag, against the ``window`` known values before."""
    w = Window.partitionBy("metric").orderBy("date").rowsBetween(-window, -1)
    k = series.where("value IS NOT NULL")
    n, sd = F.count("value").over(w), F.stddev_samp("value").over(w)
    k = k.withColumn("mean", F.when(n >= window, F.avg("value").over(w))).withColumn("std", F.when(n >= window, sd))
    k = k.withColumn("z", (F.col("value") - F.col("mean")) / F.when(F.col("std") > 1e-12, F.col("std")))
    k = k.withColumn("flag", F.when(F.col("mean").isNull(), "insufficient_history").when(F.abs("z") > z, "drift").otherwise("ok"))
    missing = series.where("value IS NULL").select("metric", "date", "value", *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "z")], F.lit("missing").alias("flag"))
    return k.select("metric", "date", "value", "mean", "std", "z", "flag").unionByName(missing)


def stability(series: DataFrame) -> DataFrame:
    """metric, n, mean, std (0 where all are equal), min, max, cv, positive_rate."""
    sd: Column = F.when(F.max("value") == F.min("value"), 0.0).otherwise(F.stddev_samp("value"))
    return series.where("value IS NOT NULL").groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), sd.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (sd / F.nullif(F.abs(F.avg("value")), F.lit(0.0))).alias("cv"), F.avg((F.col("value") > 0).cast("double")).alias("positive_rate"))
