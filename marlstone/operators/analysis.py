"""From statements, prices and texts to scores, labels and research signals.

Signals are research output, not financial advice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import average_rank, clamp, count_of, inverted, mean_of, occurrences, pct_change, safe_div, scale, sentences

#: Weights of the score, thresholds of labels, signals and screening.
WEIGHTS = {"quality": 0.25, "growth": 0.20, "valuation": 0.20, "momentum": 0.15, "disclosure": 0.10}
RISK_WEIGHT = 0.10
STRONG, CANDIDATE, WATCHLIST, AVOID = 80, 65, 50, 35
BUY, SELL, SIGNAL_CONFIDENCE, BUY_RISK = 78, 35, 55, 45
MIN_CONFIDENCE, MIN_COVERAGE, MIN_SUBSCORES = 30, 40, 2
SEVERITY = {"low": 5, "medium": 15, "high": 30, "critical": 50}
COUNTED = ("positive", "negative", "risk", "uncertainty")


def latest_two(statements: DataFrame) -> DataFrame:
    """Per ticker the latest statement and, with prior_ names, the one before; an unknown year counts as latest."""
    keep = [c for c in statements.columns if c != "ticker"]
    order = Window.partitionBy("ticker").orderBy(F.col("fiscal_year").desc_nulls_first(), F.desc("fiscal_period"))
    r = statements.withColumn("__k", F.row_number().over(order)).where("__k <= 2")
    at = lambda c, k: F.max(F.when(F.col("__k") == k, F.col(c)))
    return r.groupBy("ticker").agg(*[at(c, 1).alias(c) for c in keep], *[at(c, 2).alias(f"prior_{c}") for c in keep])


FUNDAMENTAL = ("revenue_growth_yoy", "operating_income_growth_yoy", "eps_growth_yoy", "operating_margin", "net_margin", "roe", "roa", "equity_ratio", "free_cash_flow", "free_cash_flow_margin", "payout_ratio")


def fundamentals(statements: DataFrame) -> DataFrame:
    """Growth, margins, returns, cash flow and payout of each ticker's latest statement."""
    s = latest_two(statements)
    fcf = F.col("operating_cash_flow") - F.col("capital_expenditure")
    m = {
        "revenue_growth_yoy": pct_change("revenue", "prior_revenue"), "operating_income_growth_yoy": pct_change("operating_income", "prior_operating_income"), "eps_growth_yoy": pct_change("eps", "prior_eps"),
        "operating_margin": safe_div("operating_income", "revenue") * 100, "net_margin": safe_div("net_income", "revenue") * 100, "roe": safe_div("net_income", "equity") * 100, "roa": safe_div("net_income", "total_assets") * 100,
        "equity_ratio": safe_div("equity", "total_assets") * 100, "free_cash_flow": fcf, "free_cash_flow_margin": safe_div(fcf, "revenue") * 100,
        "payout_ratio": F.when(F.col("eps") > 0, safe_div("dividends_per_share", "eps") * 100),
    }
    out = s.withColumns(m)
    known = count_of(*[F.col(c) for c in FUNDAMENTAL])
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in FUNDAMENTAL]), lambda x: x.isNotNull())
    return out.withColumn("fundamentals_confidence", known / float(len(FUNDAMENTAL)) * 100).withColumn("missing_fundamentals", missing)


def valuation(fund: DataFrame, prices: DataFrame) -> DataFrame:
    """Multiples at the latest raw close; nothing without a positive price."""
    f = fund.join(prices.select("ticker", F.col("last_close").alias("price")), "ticker", "left")
    ok = F.col("price") > 0
    cap = F.when(ok & (F.col("shares_outstanding") > 0), F.col("price") * F.col("shares_outstanding"))
    per = F.when(ok & (F.col("eps") > 0), F.col("price") / F.col("eps"))
    pbr = F.when(ok & (F.col("bps") > 0), F.col("price") / F.col("bps"))
    f = f.withColumns({"per": per, "pbr": pbr, "market_cap": cap})
    f = f.withColumns({"psr": F.when(F.col("revenue") > 0, F.col("market_cap") / F.col("revenue")), "dividend_yield": F.when(ok, F.col("dividends_per_share") / F.col("price") * 100), "peg": F.when(F.col("eps_growth_yoy") > 0, F.col("per") / F.col("eps_growth_yoy"))})
    cheap, dear = (F.col("per") < 12) | (F.col("pbr") < 1), (F.col("per") > 30) | (F.col("pbr") > 4)
    no = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(F.col("per").isNull() & F.col("pbr").isNull(), "unavailable").when(no(cheap) & no(dear), "fair").when(no(cheap), "cheap").when(no(dear), "expensive").otherwise("fair")
    return f.withColumn("valuation_class", kind).withColumn("valuation_confidence", count_of(*[F.col(c) for c in ("per", "pbr", "psr", "peg", "dividend_yield", "market_cap")]) / 6.0 * 100)


def findings(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row for each rule and sentence that holds its keyword; the lexicon is a small table of rules."""
    s = texts.select("ticker", F.posexplode(sentences("text")).alias("sentence_no", "sentence"))
    hit = s.join(F.broadcast(lexicon), F.col("sentence").contains(F.col("keyword")))
    return hit.select("ticker", "rule_id", "category", "sentence_no", F.substring("sentence", 1, 200).alias("evidence"), "severity", "confidence", "tone_weight")


def tone(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per ticker: findings by category, tone within -100 and 100, confidence by number of hits and text length."""
    f = findings(texts, lexicon).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("tone_weight").alias("t"), *[F.sum((F.col("category") == c).cast("int")).alias(f"n_{c}") for c in COUNTED], F.max((F.col("severity") == "critical").cast("int")).alias("crit"))
    j = texts.select("ticker", F.length(F.coalesce("text", F.lit(""))).alias("size")).join(f, "ticker", "left").fillna(0, ["n", "t", "crit", *[f"n_{c}" for c in COUNTED]])
    base = F.when(F.col("n") == 0, F.lit(30.0)).otherwise(F.least(F.lit(90.0), 50.0 + 5 * F.col("n")))
    conf = F.when(F.col("size") == 0, 0.0).when(F.col("size") < 100, F.greatest(F.lit(10.0), base - 20)).otherwise(base)
    return j.select("ticker", F.col("n").alias("n_findings"), clamp("t", -100, 100).alias("tone_score"), *[F.col(f"n_{c}").cast("long").alias(f"n_{c}") for c in COUNTED], (F.col("crit") > 0).alias("has_critical"), conf.alias("disclosure_confidence"))


def keyword_counts(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """ticker, category, n: non-overlapping occurrences of the category's keywords."""
    return texts.crossJoin(F.broadcast(lexicon)).groupBy("ticker", "category").agg(F.sum(occurrences("text", "keyword")).alias("n"))


def no_findings(texts: DataFrame) -> DataFrame:
    """An analyzer that finds nothing, with confidence 0."""
    return texts.select("ticker", F.lit(0).cast("long").alias("n_findings"), F.lit(0.0).alias("tone_score"), *[F.lit(0).cast("long").alias(f"n_{c}") for c in COUNTED], F.lit(False).alias("has_critical"), F.lit(0.0).alias("disclosure_confidence"))


def risk_flags(df: DataFrame) -> DataFrame:
    """Adds flags (risk, severity), their score and confidence. ``df`` has fundamentals, valuation, momentum and tone."""
    flag = lambda risk, sev, when: F.when(when, F.struct(F.lit(risk).alias("risk"), F.lit(sev).alias("severity")))
    c = F.col
    two = lambda risk, hi, hi_when, lo, lo_when: F.coalesce(flag(risk, hi, hi_when), flag(risk, lo, lo_when))
    missing = count_of(*[F.when(c(x).isNull(), 1) for x in ("fundamentals_confidence", "valuation_confidence", "confidence", "disclosure_confidence")])
    weak = lambda x: c(x).isNull() | (c(x) < 5)
    flags = [
        flag("negative_eps", "high", c("eps") < 0),
        two("revenue_decline", "high", c("revenue_growth_yoy") <= -10, "medium", c("revenue_growth_yoy") < 0),
        two("operating_income_decline", "high", c("operating_income_growth_yoy") <= -15, "medium", c("operating_income_growth_yoy") < 0),
        two("thin_equity", "high", c("equity_ratio") < 20, "medium", c("equity_ratio") < 30),
        flag("expensive_without_growth", "medium", (c("valuation_class") == "expensive") & weak("revenue_growth_yoy") & weak("eps_growth_yoy")),
        two("volatility", "high", c("volatility") >= 60, "medium", c("volatility") >= 40),
        two("drawdown", "high", c("max_drawdown") <= -40, "medium", c("max_drawdown") <= -25),
        two("disclosure", "critical", c("has_critical"), "medium", (c("tone_score") <= -10) & (c("n_negative") >= 1)),
        two("uncertainty", "medium", c("n_uncertainty") >= 5, "low", c("n_uncertainty") >= 3),
        flag("missing_inputs", "medium", missing > 0),
    ]
    d = df.withColumn("risk_flags", F.filter(F.array(*flags), lambda x: x.isNotNull()))
    weight = lambda s: F.when(s == "low", 5).when(s == "medium", 15).when(s == "high", 30).otherwise(50)
    d = d.withColumn("risk_score", F.least(F.lit(100), F.aggregate("risk_flags", F.lit(0), lambda a, x: a + weight(x["severity"]))).cast("double"))
    return d.withColumn("risk_confidence", F.greatest(F.lit(20.0), 100.0 - 20 * missing)).withColumn("has_critical_flag", F.exists("risk_flags", lambda x: x["severity"] == "critical"))


def scores(df: DataFrame) -> DataFrame:
    """Adds the five sub-scores, the final score and its confidence."""
    sub = {
        "quality": mean_of(scale("operating_margin", 0, 20), scale("roe", 0, 15), scale("equity_ratio", 10, 60), scale("free_cash_flow_margin", -5, 15)),
        "growth": mean_of(scale("revenue_growth_yoy", -10, 20), scale("operating_income_growth_yoy", -15, 30), scale("eps_growth_yoy", -15, 30)),
        "valuation": mean_of(inverted("per", 8, 35), inverted("pbr", 0.8, 4), scale("dividend_yield", 0, 4)),
        "momentum": mean_of(scale("ret_3m", -20, 20), scale("ret_6m", -25, 25), scale("ret_12m", -30, 30), scale("max_drawdown", -50, 0)),
        "disclosure": F.when(F.col("n_findings") > 0, clamp(50 + F.col("tone_score"), 0, 100)),
    }
    d = df.withColumns({f"{k}_score": x for k, x in sub.items()})
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.coalesce(F.col(f"{k}_score") * w, F.lit(0.0))
        weight = weight + F.when(F.col(f"{k}_score").isNotNull(), w).otherwise(0.0)
    final = clamp(total / F.when(weight > 0, weight) - F.coalesce(F.col("risk_score"), F.lit(0.0)) * RISK_WEIGHT, 0, 100)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    conf = (zero("fundamentals_confidence") + zero("valuation_confidence") + zero("confidence") + zero("disclosure_confidence") + zero("risk_confidence")) / 5
    return d.withColumn("final_score", final).withColumn("score_confidence", conf)


SECTOR_METRICS = (("operating_margin", True), ("roe", True), ("revenue_growth_yoy", True), ("equity_ratio", True), ("per", False), ("pbr", False), ("ret", True))


def sector_relative(df: DataFrame) -> DataFrame:
    """Adds percentiles against the other names of the sector, ties counting half; no self-join."""
    d = df.withColumn("ret", F.coalesce("ret_3m", "ret_6m"))
    known = F.col("sector").isNotNull()
    for m, up in SECTOR_METRICS:
        n = F.count(m).over(Window.partitionBy("sector"))
        p = (average_rank(m, "sector", ascending=up) - 1) / F.nullif(n - 1, F.lit(0)) * 100
        d = d.withColumn(f"pct_{m}", F.when(known, p))
    names = F.count("*").over(Window.partitionBy("sector"))
    pct = [F.round(f"pct_{m}", 1) for m, _ in SECTOR_METRICS]
    have = known & (names >= 2)
    d = d.withColumn("sector_size", F.when(known, names))
    d = d.withColumn("sector_relative_score", F.when(have, mean_of(*pct)))
    return d.withColumn("sector_confidence", F.when(have, count_of(*pct) / float(len(pct)) * F.least(F.lit(1.0), names / 4.0) * 100))


def reliability(df: DataFrame) -> DataFrame:
    """Adds coverage, screening score, eligibility and grade."""
    have = F.lit(0)
    for c in ("fundamentals_confidence", "valuation_confidence", "confidence", "disclosure_confidence", "risk_confidence"):
        have = have + F.when(F.col(c) > 0, 20).otherwise(0)
    subs = count_of(*[F.col(f"{k}_score") for k in WEIGHTS])
    d = df.withColumn("coverage", have.cast("double")).withColumn("n_subscores", subs)
    d = d.withColumn("screening_score", F.round(F.col("final_score") * F.col("score_confidence") / 100 * F.col("coverage") / 100, 1))
    ok = F.col("final_score").isNotNull() & (F.col("score_confidence") >= MIN_CONFIDENCE) & (F.col("coverage") >= MIN_COVERAGE) & (F.col("n_subscores") >= MIN_SUBSCORES)
    d = d.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    grade = F.when(~F.col("eligible"), "insufficient").when((F.col("score_confidence") >= 70) & (F.col("coverage") >= 80), "high").when(F.col("score_confidence") >= 50, "medium").otherwise("low")
    return d.withColumn("grade", grade)


def screening(df: DataFrame) -> DataFrame:
    """Adds label and rank. The rank is over all names: one sort of a row per ticker."""
    s, conf = F.col("final_score"), F.col("score_confidence")
    label = F.when(s.isNull() | (conf < MIN_CONFIDENCE), "insufficient_data").when(s >= STRONG, "strong_candidate").when(s >= CANDIDATE, "candidate").when(s >= WATCHLIST, "watchlist").when(s <= AVOID, "avoid").otherwise("watchlist")
    order = Window.orderBy(F.desc("eligible"), F.desc_nulls_last("screening_score"), F.desc_nulls_last("final_score"), F.asc("ticker"))
    return df.withColumn("label", label).withColumn("rank", F.row_number().over(order))


def signals(df: DataFrame) -> DataFrame:
    """Adds a research signal by an ordered ladder; the valuation sub-score never counts as support."""
    support = F.lit(0)
    for k in ("quality", "growth", "momentum", "disclosure"):
        support = support + F.when(F.col(f"{k}_score") >= 60, 1).otherwise(0)
    support = support + F.when(F.col("n_positive") >= 2, 1).otherwise(0)
    s, risk, crit = F.col("final_score"), F.col("risk_score"), F.col("has_critical_flag")
    d = df.withColumn("n_support", support)
    sig = (
        F.when(s.isNull() | (F.col("score_confidence") < SIGNAL_CONFIDENCE), "insufficient_data")
        .when((s <= SELL) | (crit & (s < CANDIDATE)), "sell_candidate")
        .when(crit | (risk >= 70), "avoid")
        .when((s >= BUY) & (risk <= BUY_RISK) & (F.col("n_support") >= 2), "buy_candidate")
        .when(s >= CANDIDATE, "watch")
        .when(risk >= 60, "avoid")
        .otherwise("hold")
    )
    return d.withColumn("signal", sig)
