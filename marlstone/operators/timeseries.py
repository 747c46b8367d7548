"""Per-ticker series: returns, rolling measures, drawdown, momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ranks import ranks_within
from ..functions.semantics import full, nn


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def lag_return(price: str, k: int) -> Column:
    return F.col(price) / nn(F.lag(price, k).over(by_date())) - 1


def daily_features(bars: DataFrame, *, lookback: int = 20, min_turnover: float | None = None, min_rows: bool = True) -> DataFrame:
    """Returns of 1, 5 and 20 rows, gaps, ranges, rolling volatility and liquidity, as fractions.

    One shuffle by ticker serves all windows. Rolling measures need a full
    window. Rows below ``min_turnover`` go, then tickers with fewer than
    max(lookback, 20) + 1 rows left.
    """
    roll = by_date().rowsBetween(1 - lookback, 0)
    f = bars.select("ticker", "date", "adj_open", "adj_high", "adj_low", "adj_close", "volume", "turnover_value")
    f = f.withColumn("ret_1d", lag_return("adj_close", 1)).withColumn("ret_5d", lag_return("adj_close", 5)).withColumn("ret_20d", lag_return("adj_close", 20))
    f = f.withColumn("overnight_gap", F.col("adj_open") / nn(F.lag("adj_close", 1).over(by_date())) - 1)
    f = f.withColumn("intraday_return", F.col("adj_close") / nn("adj_open") - 1).withColumn("range_pct", F.col("adj_high") / nn("adj_low") - 1)
    f = f.withColumn("volatility_20d", full(F.stddev_samp("ret_1d"), F.col("ret_1d"), roll, lookback))
    f = f.withColumn("avg_volume_20d", full(F.avg("volume"), F.col("volume"), roll, lookback)).withColumn("avg_turnover_20d", full(F.avg("turnover_value"), F.col("turnover_value"), roll, lookback))
    if min_turnover is not None:
        f = f.where(F.col("avg_turnover_20d") >= min_turnover)
    if min_rows:
        f = f.withColumn("n_rows", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("n_rows") >= max(lookback, 20) + 1).drop("n_rows")
    return f


def date_ranks(features: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Descending least ranks of measures within a date; NULL isn't ranked."""
    return ranks_within(features, ["date"], measures, ascending=False, method="min")


def momentum(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row per ticker: returns, averages, volatility, drawdown and volume trend at its last bar.

    Prices are adjusted where a row has that, else raw. Volatility needs 21
    bars; confidence grows with the bars up to a year of them.
    """
    b = bars if as_of is None else bars.where(F.col("date") <= F.to_date(F.lit(as_of)))
    b = b.select("ticker", "date", F.coalesce("adj_close", "close").alias("p"), F.col("close").alias("raw_close"), "volume")
    at = Window.partitionBy("ticker").orderBy(F.desc("date"))
    b = b.withColumn("ret", F.col("p") / nn(F.lag("p").over(by_date())) - 1).withColumn("peak", F.max("p").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("back", F.row_number().over(at) - 1)
    # Of volumes that are known, the last twenty and the twenty before.
    b = b.withColumn("v_back", F.when(F.col("volume").isNotNull(), F.count("volume").over(at.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    price = lambda k: F.max(F.when(F.col("back") == k, F.col("p")))
    last = price(0)

    def ret(k: int) -> Column:
        return (last / F.nullif(price(k), F.lit(0.0)) - 1) * 100

    def mean(k: int) -> Column:
        return F.when(F.count("*") >= k, F.avg(F.when(F.col("back") < k, F.col("p"))))

    recent, prior = F.avg(F.when(F.col("v_back") < 20, F.col("volume"))), F.avg(F.when(F.col("v_back").between(20, 39), F.col("volume")))
    n = F.count("*")
    ratio = recent / F.nullif(prior, F.lit(0.0))
    return b.groupBy("ticker").agg(
        F.max("date").alias("analysis_date"),
        F.max(F.when(F.col("back") == 0, F.col("raw_close"))).alias("last_close"),
        n.alias("n_bars"),
        ret(21).alias("ret_1m"), ret(63).alias("ret_3m"), ret(126).alias("ret_6m"), ret(252).alias("ret_12m"),
        *[mean(k).alias(f"ma_{k}") for k in (20, 60, 120, 200)],
        F.when(n >= 21, F.stddev_samp("ret") * F.sqrt(F.lit(252.0)) * 100).alias("volatility"),
        (F.min(F.least(F.lit(0.0), F.col("p") / F.nullif(F.col("peak"), F.lit(0.0)) - 1)) * 100).alias("max_drawdown"),
        F.when(F.count("volume") < 40, "unavailable").when(ratio > 1.1, "rising").when(ratio < 0.9, "falling").when(ratio.isNotNull(), "stable").otherwise("unavailable").alias("volume_trend"),
        (F.least(F.lit(1.0), n / 252.0) * 100).alias("confidence"),
    )


def forward_returns(bars: DataFrame, dates: DataFrame, horizons=(5, 20, 60), *, price: str = "close") -> DataFrame:
    """decision_date, ticker, base date and price, and a row's return N rows on, for each horizon.

    The base is the first bar strictly after the decision date; leads are
    taken once per bar, then each decision date picks its base by the least
    date after it. No range join: a bar's date tells between which decision
    dates it and its predecessor lie. With the price "adjusted_or_close" a
    base and what follows it are adjusted if all these bars are, else not.
    """
    w = by_date()
    value, lead = F.col(price) if price != "adjusted_or_close" else None, lambda h: F.lead(price, h).over(w)
    if value is None:
        on = w.rowsBetween(0, Window.unboundedFollowing)
        whole = F.count("adj_close").over(on) == F.count("*").over(on)
        value, lead = F.when(whole, F.col("adj_close")).otherwise(F.col("close")), lambda h: F.when(whole, F.lead("adj_close", h).over(w)).otherwise(F.lead("close", h).over(w))
    b = bars.select("ticker", "date", value.alias("base_price"), F.lag("date").over(w).alias("before"), *[lead(h).alias(f"later_{h}") for h in horizons], *[F.lead("date", h).over(w).alias(f"date_{h}") for h in horizons])
    # Decision dates are a short list: each bar keeps those that lie from its predecessor's day up to the day before it.
    base = b.join(F.broadcast(dates), (F.col("decision_date") < F.col("date")) & (F.col("before").isNull() | (F.col("decision_date") >= F.col("before"))))
    good = F.col("base_price") > 0
    return base.select("decision_date", "ticker", F.col("date").alias("base_date"), "base_price", *[F.when(good, (F.col(f"later_{h}") / nn("base_price") - 1) * 100).alias(f"forward_return_h{h}") for h in horizons], *[F.when(~good, "bad_base_price").when(F.col(f"later_{h}").isNull(), "not_enough_rows").otherwise("ok").alias(f"status_h{h}") for h in horizons])


def rows_after(bars: DataFrame, disclosed: DataFrame) -> DataFrame:
    """ticker, disclosure_date, n_after: bars strictly after a date, as a range count in one union, without a join of ranges."""
    marks = disclosed.select("ticker", F.col("disclosure_date").alias("date"), F.lit(1).alias("mark")).unionByName(bars.select("ticker", "date", F.lit(0).alias("mark")))
    later = Window.partitionBy("ticker").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumn("upto", F.sum(1 - F.col("mark")).over(later)).withColumn("n_all", F.sum(1 - F.col("mark")).over(Window.partitionBy("ticker")))
    return seen.where("mark = 1").select("ticker", F.col("date").alias("disclosure_date"), (F.col("n_all") - F.col("upto")).alias("n_after"))


def readiness(bars: DataFrame, disclosed: DataFrame, horizons=(5, 20, 60), *, every: bool = False) -> DataFrame:
    """Per ticker and horizon: whether N + 1 bars follow its latest disclosure, or ``every`` one of its disclosures, and why not."""
    asked = disclosed.select("ticker", "disclosure_date").distinct() if every else disclosed.groupBy("ticker").agg(F.max("disclosure_date").alias("disclosure_date"))
    counted = rows_after(bars, asked.where("disclosure_date IS NOT NULL"))
    priced = bars.select("ticker").distinct().withColumn("priced", F.lit(True))
    j = asked.join(counted, ["ticker", "disclosure_date"], "left").join(priced, "ticker", "left")
    j = j.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    reason = F.when(F.col("disclosure_date").isNull(), "no_disclosure_date").when(F.col("priced").isNull(), "no_prices").when(F.coalesce("n_after", F.lit(0)) == 0, "no_rows_after_disclosure").when(F.col("n_after") < F.col("horizon") + 1, "not_enough_rows")
    return j.select("ticker", "horizon", "disclosure_date", F.coalesce("n_after", F.lit(0)).alias("n_after"), reason.isNull().alias("eligible"), F.coalesce(reason, F.lit("")).alias("reason"))


def grouped_summary(results: DataFrame, dimensions: list[str], horizons=(5, 20, 60)) -> DataFrame:
    """Forward returns by each of several independent dimensions and horizon, as grouping sets in one pass."""
    long = results.select(*dimensions, F.expr("stack(" + str(len(horizons)) + ", " + ", ".join(f"{h}, forward_return_h{h}" for h in horizons) + ") AS (horizon, ret)"))
    pick = lambda of: F.coalesce(*[F.when(F.grouping(d) == 0, of(d)) for d in dimensions])
    hit = F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)
    return long.groupingSets([[F.col(d), F.col("horizon")] for d in dimensions], *dimensions, "horizon").agg(
        pick(F.lit).alias("dimension"), pick(lambda d: F.coalesce(F.col(d).cast("string"), F.lit("none"))).alias("value"),
        F.count("*").alias("n"), F.count("ret").alias("n_available"), (F.count("*") - F.count("ret")).alias("n_missing"),
        F.avg("ret").alias("mean_ret"), F.median("ret").alias("median_ret"), F.avg(hit).alias("hit_rate"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"),
    ).select("dimension", "value", "horizon", "n", "n_available", "n_missing", "mean_ret", "median_ret", "hit_rate", "min_ret", "max_ret")
