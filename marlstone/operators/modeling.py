"""Point-in-time factors, dataset, scores and their evaluation across names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranks_within
from ..functions.semantics import guarded_corr, mean_of, nn, occurrences, ranked_overall, safe_div
from ..sources.scratch import written
from .timeseries import by_date, forward_returns

#: Factors by group; those where less is better.
GROUPS = {
    "value": ("earnings_yield", "book_to_market", "sales_to_price"),
    "quality": ("roe", "roa", "operating_margin", "equity_ratio"),
    "growth": ("revenue_growth_yoy", "net_income_growth_yoy"),
    "momentum": ("momentum_20d", "momentum_60d", "momentum_120d"),
    "risk": ("volatility", "max_drawdown", "leverage"),
    "disclosure": ("narrative_available", "risk_keyword_count", "sentiment_placeholder"),
}
FACTORS = tuple(f for g in GROUPS.values() for f in g)
LESS_IS_BETTER = ("volatility", "leverage", "risk_keyword_count")
X = ["decision_date"]


def price_factors(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Per decision date the price factors at each ticker's last bar up to it.

    Running measures are worked out once per bar; a bar stands for the days
    up to the next one, so that no range of bars is joined.
    """
    upto = by_date().rowsBetween(Window.unboundedPreceding, 0)
    p = F.when(F.count("adj_close").over(upto) == F.count("*").over(upto), F.col("adj_close")).otherwise(F.col("close"))
    b = bars.select("ticker", "date", p.alias("p"), F.lead("date").over(by_date()).alias("next"))
    b = b.withColumn("ret", F.col("p") / nn(F.lag("p").over(by_date())) - 1).withColumn("dd", F.least(F.lit(0.0), F.col("p") / nn(F.max("p").over(upto)) - 1))
    b = b.select(
        "ticker", "date", "next", F.col("p").alias("market_price"), *[((F.col("p") / nn(F.lag("p", k).over(by_date())) - 1) * 100).alias(f"momentum_{k}d") for k in (20, 60, 120)],
        F.when(F.count("*").over(upto) >= 3, F.stddev_samp("ret").over(upto) * F.sqrt(F.lit(252.0)) * 100).alias("volatility"), (F.min("dd").over(upto) * 100).alias("max_drawdown"),
    )
    held = (F.col("decision_date") >= F.col("date")) & (F.col("next").isNull() | (F.col("decision_date") < F.col("next")))
    return b.join(F.broadcast(dates), held).drop("date", "next")  # a short list of dates


def statements_as_of(statements: DataFrame, dates: DataFrame, strict: bool = True) -> DataFrame:
    """Per decision date each ticker's latest and prior statement, of those disclosed by then if ``strict``."""
    s = statements.join(F.broadcast(dates), F.col("disclosure_date") <= F.col("decision_date")) if strict else statements.join(F.broadcast(dates))
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("decision_date", "ticker").orderBy(F.desc_nulls_first("fiscal_year"), F.desc("fiscal_period"))))
    cols = ("fiscal_year", "disclosure_date", "accounting_basis", "revenue", "net_income", "operating_income", "equity", "total_assets", "shares_outstanding")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return s.where("k <= 2").groupBy("decision_date", "ticker").agg(*[at(c, 1).alias(c) for c in cols], at("revenue", 2).alias("prior_revenue"), at("net_income", 2).alias("prior_net_income"))


def basis(statements: DataFrame) -> DataFrame:
    """ticker, basis: the one known accounting basis, mixed, or unknown."""
    known = F.nullif(F.lower(F.trim("accounting_basis")), F.lit(""))
    s = statements.groupBy("ticker").agg(F.collect_set(known).alias("b"))
    return s.select("ticker", F.when(F.size("b") == 0, "unknown").when(F.size("b") > 1, "mixed").otherwise(F.element_at("b", 1)).alias("basis"))


def dataset(bars: DataFrame, statements: DataFrame, companies: DataFrame, texts: DataFrame, dates: DataFrame, risk_words: list[str], horizons=(5, 20, 60), include_non_consolidated: bool = False) -> DataFrame:
    """A row for each decision date and ticker of the universe: factors, labels, reason of exclusion.

    Names without statements, with none disclosed by the date, or whose
    statements are all non-consolidated (unless these are asked for) are
    excluded; a mixed or unknown basis is not.
    """
    universe = bars.select("ticker").union(statements.select("ticker")).union(companies.select("ticker")).distinct()
    keys = universe.crossJoin(F.broadcast(dates))  # names by a short list of dates: the dataset's own size
    on = ["decision_date", "ticker"]
    d = keys.join(statements_as_of(statements, dates), on, "left").join(price_factors(bars, dates), on, "left").join(companies.select("ticker", "sector"), "ticker", "left").join(basis(statements), "ticker", "left")
    cap = F.col("market_price") * F.nullif(F.col("shares_outstanding"), F.lit(0.0))
    n_risk = F.lit(0)
    for w in risk_words:
        n_risk = n_risk + occurrences("text", F.lit(w))
    has = F.length(F.col("text")) > 0
    d = d.join(texts.select("ticker", F.when(F.col("text").isNotNull(), has.cast("double")).alias("narrative_available"), F.when(has, n_risk.cast("double")).alias("risk_keyword_count"), F.when(has, F.lit(0.0)).alias("sentiment_placeholder")), "ticker", "left")
    signed = lambda a, b: (F.col(a) - F.col(b)) / nn(b) * 100
    d = d.withColumns(
        {
            "earnings_yield": safe_div("net_income", cap) * 100, "book_to_market": safe_div("equity", cap), "sales_to_price": safe_div("revenue", cap), "roe": safe_div("net_income", "equity") * 100, "roa": safe_div("net_income", "total_assets") * 100,
            "operating_margin": safe_div("operating_income", "revenue") * 100, "equity_ratio": safe_div("equity", "total_assets") * 100, "leverage": safe_div("total_assets", "equity"),
            "revenue_growth_yoy": signed("revenue", "prior_revenue"), "net_income_growth_yoy": signed("net_income", "prior_net_income"),
        }
    )
    labels = forward_returns(bars, dates, horizons, price="adjusted_or_close").select(*on, *[f"forward_return_h{h}" for h in horizons])
    reason = F.when(F.col("basis").isNull(), "no_fundamentals").when(F.col("disclosure_date").isNull(), "disclosure_after_decision")
    if not include_non_consolidated:
        reason = reason.when(F.col("basis") == "non_consolidated", "non_consolidated_basis")
    d = d.join(labels, on, "left").withColumn("exclusion", F.coalesce(reason, F.lit("")))
    return d.select(*on, "sector", "basis", "exclusion", *FACTORS, *[f"forward_return_h{h}" for h in horizons])


def excess_returns(ds: DataFrame, horizons=(5, 20, 60)) -> DataFrame:
    """Adds excess_return_h{N}: over the sector's mean with two labelled peers or more, else over all names."""
    for h in horizons:
        c = f"forward_return_h{h}"
        xs = Window.partitionBy("decision_date", "sector")
        base = F.when(F.col("sector").isNotNull() & (F.col("sector") != "") & (F.count(c).over(xs) >= 2), F.avg(c).over(xs)).otherwise(F.avg(c).over(Window.partitionBy(*X)))
        ds = ds.withColumn(f"excess_return_h{h}", F.col(c) - base)
    return ds


def normalised_wide(ds: DataFrame) -> DataFrame:
    """decision_date, ticker, sector and of each factor f x_f (signed, winsorised), z_f, sz_f (within the sector).

    Clipped to the 5th and 95th percentile with two values or more; z uses the
    sample deviation and is 0 where there is none; without a sector it is 0.
    The percentiles, means and deviations of a date are one row, of a sector
    one more: names are not sorted, and no task holds a date's cross-section.
    ``ds`` is read twice: it should be a written table.
    """
    raw = {f: (-F.col(f) if f in LESS_IS_BETTER else F.col(f)) for f in FACTORS}
    limits = ds.groupBy("decision_date").agg(*[F.percentile(raw[f], F.array(F.lit(0.05), F.lit(0.95))).alias(f"q_{f}") for f in FACTORS], *[F.count(f).alias(f"n_{f}") for f in FACTORS])
    clipped = {f: F.when(raw[f].isNull() | (F.col(f"n_{f}") < 2), raw[f]).otherwise(F.least(F.greatest(raw[f], F.col(f"q_{f}")[0]), F.col(f"q_{f}")[1])) for f in FACTORS}
    # Written, as it is read three times, and so that what builds on it stays a short expression.
    x, _ = written(ds.join(F.broadcast(limits), "decision_date").select("decision_date", "ticker", "sector", *[c.alias(f"x_{f}") for f, c in clipped.items()]))

    def stats(by: list[str], mark: str) -> DataFrame:
        return x.groupBy(*by).agg(*[c.alias(f"{mark}{k}_{f}") for f in FACTORS for k, c in (("n", F.count(f"x_{f}")), ("a", F.avg(f"x_{f}")), ("s", F.stddev_samp(f"x_{f}")))])

    def z(f: str, mark: str) -> Column:
        v, sd = F.col(f"x_{f}"), F.col(f"{mark}s_{f}")
        return F.when(v.isNull(), None).when((F.col(f"{mark}n_{f}") < 2) | (F.coalesce(sd, F.lit(0.0)) < 1e-12), 0.0).otherwise((v - F.col(f"{mark}a_{f}")) / F.nullif(sd, F.lit(0.0)))

    # A row for each decision date; sectors are joined as the optimiser sees fit.
    j = x.join(F.broadcast(stats(["decision_date"], "d")), "decision_date").join(stats(["decision_date", "sector"], "s").where("sector IS NOT NULL"), ["decision_date", "sector"], "left")
    inside = {f: F.when(F.col(f"x_{f}").isNull(), None).when(F.col("sector").isNull(), 0.0).otherwise(z(f, "s")) for f in FACTORS}
    return j.select("decision_date", "ticker", "sector", *[f"x_{f}" for f in FACTORS], *[z(f, "d").alias(f"z_{f}") for f in FACTORS], *[c.alias(f"sz_{f}") for f, c in inside.items()])


def normalised(ds: DataFrame) -> DataFrame:
    """Long form of normalised_wide(): decision_date, ticker, sector, factor, x, z, sector_z."""
    triples = ", ".join(f"'{f}', x_{f}, z_{f}, sz_{f}" for f in FACTORS)
    return normalised_wide(ds).select("decision_date", "ticker", "sector", F.expr(f"stack({len(FACTORS)}, {triples}) AS (factor, x, z, sector_z)"))


def baseline_scores(ds: DataFrame, weights: dict[str, float] | None = None, of: str = "z") -> DataFrame:
    """decision_date, ticker, score, n_groups, rank_desc: weighted mean of group means over the groups there are."""
    weights = weights or dict.fromkeys(GROUPS, 1.0)
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    mark = {"x": "x", "z": "z", "sector_z": "sz"}[of]
    wide = normalised_wide(ds).select("decision_date", "ticker", *[F.col(f"{mark}_{f}").alias(f) for f in FACTORS])
    wide = wide.withColumns({f"g_{g}": mean_of(*[F.col(f) for f in fs]) for g, fs in GROUPS.items()})
    top, total, k = F.lit(0.0), F.lit(0.0), F.lit(0)
    for g in GROUPS:
        top = top + F.coalesce(F.col(f"g_{g}") * weights.get(g, 0.0), F.lit(0.0))
        total = total + F.when(F.col(f"g_{g}").isNotNull(), weights.get(g, 0.0)).otherwise(0.0)
        k = k + F.col(f"g_{g}").isNotNull().cast("int")
    score = F.round(top / F.nullif(total, F.lit(0.0)), 9)
    out = wide.select("decision_date", "ticker", score.alias("score"), k.alias("n_groups"))
    order = Window.partitionBy("decision_date").orderBy(F.desc_nulls_last("score"), "ticker")
    return out.withColumn("rank_desc", F.when(F.col("score").isNotNull(), F.row_number().over(order)))


def rank_ic(scored: DataFrame, label: str) -> DataFrame:
    """decision_date, n, ic, sector_neutral_ic: rank correlation of score and label within a date."""
    s = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()).withColumn("y", F.col(label))
    xs = Window.partitionBy("decision_date", "sector")
    s = s.withColumn("s_d", F.round(F.col("score") - F.avg("score").over(xs), 9)).withColumn("y_d", F.round(F.col("y") - F.avg("y").over(xs), 9))
    s = ranks_within(s.select("decision_date", "score", "y", "s_d", "y_d"), ["decision_date"], {f"r_{c}": c for c in ("score", "y", "s_d", "y_d")})
    return s.groupBy("decision_date").agg(F.count("*").alias("n"), guarded_corr("r_score", "r_y").alias("ic"), guarded_corr("r_s_d", "r_y_d").alias("sector_neutral_ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ics.agg(F.count("*").alias("n_dates"), F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), (F.avg("ic") / F.nullif(sd, F.lit(0.0))).alias("icir"), F.avg("sector_neutral_ic").alias("sector_neutral_ic_mean"))


def score_distribution(scored: DataFrame) -> DataFrame:
    """decision_date, n, mean, std (population), min, median, max of the scores."""
    return scored.groupBy("decision_date").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.median("score").alias("median"), F.max("score").alias("max"))


def quantile_rows(scored: DataFrame, label: str, n: int = 5) -> DataFrame:
    """decision_date, bucket, mean_label, med: bucket means of dates with at least n names."""
    s = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()).select("decision_date", "score", label)
    dates = s.groupBy("decision_date").agg(F.count("*").alias("names"), F.median(label).alias("med")).where(F.col("names") >= n)
    s = ranks_within(s.join(dates, "decision_date"), ["decision_date"], {"place": "score"})
    b = F.least(F.lit(n - 1), F.floor((F.col("place") - 1) / F.col("names") * n)).cast("int")
    return s.withColumn("bucket", b).groupBy("decision_date", "bucket").agg(F.avg(label).alias("mean_label"), F.max("med").alias("med"))


def quantile_table(scored: DataFrame, label: str, n: int = 5) -> DataFrame:
    """bucket, mean_label, n_dates: means over dates of bucket means."""
    return quantile_rows(scored, label, n).groupBy("bucket").agg(F.avg("mean_label").alias("mean_label"), F.count("*").alias("n_dates"))


def quantile_summary(scored: DataFrame, label: str, n: int = 5) -> DataFrame:
    """One row: mean spread of top and bottom bucket, and how often the top is above zero and above the median."""
    d = quantile_rows(scored, label, n).groupBy("decision_date").agg(F.max(F.when(F.col("bucket") == n - 1, F.col("mean_label"))).alias("top"), F.max(F.when(F.col("bucket") == 0, F.col("mean_label"))).alias("bottom"), F.max("med").alias("med"))
    share = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))) / F.nullif(F.count("*"), F.lit(0))
    return d.agg(F.count("*").alias("n_dates"), F.avg(F.col("top") - F.col("bottom")).alias("spread_mean"), share(F.col("top") > 0).alias("hit_positive"), share(F.col("top") > F.col("med")).alias("hit_above_median"))


def rank_average(models: dict[str, DataFrame]) -> DataFrame:
    """decision_date, ticker, score: mean of average ranks over rows that all models score."""
    rows = ranks_within(_common(models), ["decision_date"], {f"r_{m}": f"s_{m}" for m in models})
    out = F.lit(0.0)
    for m in models:
        out = out + F.col(f"r_{m}")
    return rows.select("decision_date", "ticker", (out / len(models)).alias("score"))


def _common(models: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for m, df in models.items():
        part = df.where("score IS NOT NULL").select("decision_date", "ticker", F.col("score").alias(f"s_{m}"))
        rows = part if rows is None else rows.join(part, ["decision_date", "ticker"])
    return rows


def weighted_blend(models: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """decision_date, ticker, score: weighted mean of per-date z-scores (population deviation)."""
    weights = {m: w for m, w in weights.items() if w > 0}
    total = sum(weights.values())
    rows, w = _common({m: models[m] for m in weights}), Window.partitionBy("decision_date")
    out = F.lit(0.0)
    for m, k in weights.items():
        c = f"s_{m}"
        sd = F.stddev_pop(c).over(w)
        out = out + F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0))) * (k / total)
    return rows.select("decision_date", "ticker", out.alias("score"))


def pairwise_corr(models: dict[str, DataFrame]) -> DataFrame:
    """pair, corr: rank correlations of models over all common rows."""
    ranked, names = written(_common(models))[0], sorted(models)  # ranked once for each model
    for m in names:
        ranked = ranked_overall(ranked, f"s_{m}", f"r_{m}")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = ranked.agg(*[guarded_corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}|{b}', `{a}|{b}`" for a, b in pairs) + ") AS (pair, corr)"))


def contribution(candidate: DataFrame, base: DataFrame, label: str) -> DataFrame:
    """decision_date, ic_raw, ic_neutral, delta: rank IC of a candidate before and after regressing out the base score."""
    j = candidate.join(base.select("decision_date", "ticker", F.col("score").alias("b")), ["decision_date", "ticker"], "left").where(F.col("score").isNotNull() & F.col("b").isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy("decision_date")
    sxx = F.var_pop("b").over(w)
    slope = (F.avg(F.col("score") * F.col("b")).over(w) - F.avg("score").over(w) * F.avg("b").over(w)) / F.when(sxx > 1e-12, sxx)
    j = j.withColumn("rest", F.round(F.col("score") - F.avg("score").over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col("b") - F.avg("b").over(w)), 8))
    j = ranks_within(j.select("decision_date", "score", "rest", label), ["decision_date"], {"r_s": "score", "r_r": "rest", "r_y": label})
    out = j.groupBy("decision_date").agg(guarded_corr("r_s", "r_y").alias("ic_raw"), guarded_corr("r_r", "r_y").alias("ic_neutral"))
    return out.withColumn("delta", F.col("ic_neutral") - F.col("ic_raw"))
