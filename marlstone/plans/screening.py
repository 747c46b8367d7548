"""Queries from statements, prices and texts to scores and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import r6
from ..operators import analysis as a
from ..operators import timeseries as t
from ..sources import views as v
from .base import query

W = "(PARTITION BY ticker ORDER BY date)"


def sc(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({x}) - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE))) * 100 END"


def mean_sql(*xs: str) -> str:
    top = " + ".join(f"coalesce({x}, 0::DOUBLE)" for x in xs)
    n = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END" for x in xs)
    return f"(({top}) / nullif({n}, 0))"


def count_sql(*xs: str) -> str:
    return "(" + " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END" for x in xs) + ")"


FUND = f"""
s2 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC NULLS FIRST, fiscal_period DESC) AS k,
              lead(revenue) OVER w AS p_revenue, lead(operating_income) OVER w AS p_oi, lead(eps) OVER w AS p_eps
       FROM statements WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year DESC NULLS FIRST, fiscal_period DESC)),
fu0 AS (
    SELECT *, (revenue - p_revenue) / nullif(abs(p_revenue), 0) * 100 AS revenue_growth_yoy,
           (operating_income - p_oi) / nullif(abs(p_oi), 0) * 100 AS operating_income_growth_yoy,
           (eps - p_eps) / nullif(abs(p_eps), 0) * 100 AS eps_growth_yoy,
           operating_income / nullif(revenue, 0) * 100 AS operating_margin, net_income / nullif(revenue, 0) * 100 AS net_margin,
           net_income / nullif(equity, 0) * 100 AS roe, net_income / nullif(total_assets, 0) * 100 AS roa,
           equity / nullif(total_assets, 0) * 100 AS equity_ratio, operating_cash_flow - capital_expenditure AS free_cash_flow,
           (operating_cash_flow - capital_expenditure) / nullif(revenue, 0) * 100 AS free_cash_flow_margin,
           CASE WHEN eps > 0 THEN dividends_per_share / nullif(eps, 0) * 100 END AS payout_ratio
    FROM s2 WHERE k = 1),
fu AS (SELECT *, {count_sql(*a.FUNDAMENTAL)} / {len(a.FUNDAMENTAL)}.0::DOUBLE * 100 AS fundamentals_confidence FROM fu0)"""
MOM = f"""
mo0 AS (
    SELECT ticker, date, close AS raw_close, coalesce(adj_close, close) AS p, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back,
           coalesce(adj_close, close) / nullif(lag(coalesce(adj_close, close)) OVER {W}, 0) - 1 AS ret,
           max(coalesce(adj_close, close)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM bars),
mo AS (
    SELECT ticker, max(date) AS analysis_date, max(raw_close) FILTER (back = 0) AS last_close, count(*) AS n_bars,
           {", ".join(f"(max(p) FILTER (back = 0) / max(p) FILTER (back = {k}) - 1) * 100 AS {n}" for n, k in (("ret_1m", 21), ("ret_3m", 63), ("ret_6m", 126), ("ret_12m", 252)))},
           {", ".join(f"CASE WHEN count(*) >= {k} THEN avg(p) FILTER (back < {k}) END AS ma_{k}" for k in (20, 60, 120, 200))},
           CASE WHEN count(*) >= 21 THEN stddev_samp(ret) * sqrt(252.0::DOUBLE) * 100 END AS volatility,
           min(least(0, p / nullif(peak, 0) - 1)) * 100 AS max_drawdown,
           CASE WHEN count(volume) < 40 THEN 'unavailable'
                WHEN avg(volume) FILTER (back < 20) / avg(volume) FILTER (back BETWEEN 20 AND 39) > 1.1 THEN 'rising'
                WHEN avg(volume) FILTER (back < 20) / avg(volume) FILTER (back BETWEEN 20 AND 39) < 0.9 THEN 'falling' ELSE 'stable' END AS volume_trend,
           least(1.0::DOUBLE, count(*) / 252.0::DOUBLE) * 100 AS confidence
    FROM mo0 GROUP BY 1)"""
VAL = f"""
va0 AS (
    SELECT fu.*, last_close AS price, CASE WHEN last_close > 0 AND eps > 0 THEN last_close / eps END AS per, CASE WHEN last_close > 0 AND bps > 0 THEN last_close / bps END AS pbr,
           CASE WHEN last_close > 0 AND shares_outstanding > 0 THEN last_close * shares_outstanding END AS market_cap
    FROM fu LEFT JOIN mo USING (ticker)),
va1 AS (
    SELECT *, CASE WHEN revenue > 0 THEN market_cap / revenue END AS psr, CASE WHEN price > 0 THEN dividends_per_share / price * 100 END AS dividend_yield,
           CASE WHEN eps_growth_yoy > 0 THEN per / eps_growth_yoy END AS peg FROM va0),
va AS (
    SELECT *, CASE WHEN per IS NULL AND pbr IS NULL THEN 'unavailable'
                   WHEN coalesce(per < 12 OR pbr < 1, FALSE) AND coalesce(per > 30 OR pbr > 4, FALSE) THEN 'fair'
                   WHEN coalesce(per < 12 OR pbr < 1, FALSE) THEN 'cheap' WHEN coalesce(per > 30 OR pbr > 4, FALSE) THEN 'expensive' ELSE 'fair' END AS valuation_class,
           {count_sql("per", "pbr", "psr", "peg", "dividend_yield", "market_cap")} / 6.0::DOUBLE * 100 AS valuation_confidence FROM va1)"""
TONE = f"""
{v.LEXICON_SQL},
sen0 AS (SELECT ticker, list_filter(list_transform(string_split_regex(text, '[.。\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS ss FROM disclosures),
sen AS (SELECT ticker, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS sentence_no FROM sen0),
fi AS (SELECT ticker, rule_id, category, sentence_no, left(sentence, 200) AS evidence, severity, confidence, tone_weight FROM sen JOIN lexicon ON contains(sentence, keyword)),
fi1 AS (SELECT ticker, count(*) AS n, sum(tone_weight)::DOUBLE AS t, {", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in a.COUNTED)}, max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS crit FROM fi GROUP BY 1),
tn0 AS (SELECT ticker, length(coalesce(text, '')) AS size, coalesce(n, 0) AS n, coalesce(t, 0) AS t, {", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c in a.COUNTED)}, coalesce(crit, 0) AS crit,
               CASE WHEN coalesce(n, 0) = 0 THEN 30.0::DOUBLE ELSE least(90.0::DOUBLE, 50.0::DOUBLE + 5 * n) END AS base FROM disclosures LEFT JOIN fi1 USING (ticker)),
tn AS (SELECT ticker, n AS n_findings, least(100, greatest(-100, t)) AS tone_score, {", ".join(f"n_{c}" for c in a.COUNTED)}, crit > 0 AS has_critical,
              CASE WHEN size = 0 THEN 0 WHEN size < 100 THEN greatest(10, base - 20) ELSE base END AS disclosure_confidence FROM tn0)"""
MISSING = count_sql(*[f"CASE WHEN {x} IS NULL THEN 1 END" for x in ("fundamentals_confidence", "valuation_confidence", "confidence", "disclosure_confidence")])


def _two(hi: str, hv: int, lo: str, lv: int) -> str:
    return f"CASE WHEN {hi} THEN {hv} WHEN {lo} THEN {lv} ELSE 0 END"


FLAG_WEIGHTS = [
    "CASE WHEN eps < 0 THEN 30 ELSE 0 END", _two("revenue_growth_yoy <= -10", 30, "revenue_growth_yoy < 0", 15), _two("operating_income_growth_yoy <= -15", 30, "operating_income_growth_yoy < 0", 15),
    _two("equity_ratio < 20", 30, "equity_ratio < 30", 15), "CASE WHEN valuation_class = 'expensive' AND (revenue_growth_yoy IS NULL OR revenue_growth_yoy < 5) AND (eps_growth_yoy IS NULL OR eps_growth_yoy < 5) THEN 15 ELSE 0 END",
    _two("volatility >= 60", 30, "volatility >= 40", 15), _two("max_drawdown <= -40", 30, "max_drawdown <= -25", 15), _two("has_critical", 50, "tone_score <= -10 AND n_negative >= 1", 15), _two("n_uncertainty >= 5", 15, "n_uncertainty >= 3", 5),
    f"CASE WHEN {MISSING} > 0 THEN 15 ELSE 0 END",
]
ALL = f"""
al AS (SELECT ticker, va.* EXCLUDE (ticker), mo.* EXCLUDE (ticker), tn.* EXCLUDE (ticker), sector, company_name FROM va FULL JOIN mo USING (ticker) LEFT JOIN tn USING (ticker) LEFT JOIN companies USING (ticker)),
rk0 AS (SELECT *, [{", ".join(FLAG_WEIGHTS)}] AS fw, {MISSING} AS n_missing FROM al),
rk AS (SELECT *, CAST(least(100, list_sum(fw)) AS DOUBLE) AS risk_score, CAST(greatest(20, 100 - 20 * n_missing) AS DOUBLE) AS risk_confidence, len(list_filter(fw, lambda x: x > 0)) AS n_flags, coalesce(list_contains(fw, 50), FALSE) AS has_critical_flag FROM rk0),
sb AS (
    SELECT *, {mean_sql(sc("operating_margin", 0, 20), sc("roe", 0, 15), sc("equity_ratio", 10, 60), sc("free_cash_flow_margin", -5, 15))} AS quality_score,
           {mean_sql(sc("revenue_growth_yoy", -10, 20), sc("operating_income_growth_yoy", -15, 30), sc("eps_growth_yoy", -15, 30))} AS growth_score,
           {mean_sql("100 - " + sc("per", 8, 35), "100 - " + sc("pbr", 0.8, 4), sc("dividend_yield", 0, 4))} AS valuation_score,
           {mean_sql(sc("ret_3m", -20, 20), sc("ret_6m", -25, 25), sc("ret_12m", -30, 30), sc("max_drawdown", -50, 0))} AS momentum_score,
           CASE WHEN n_findings > 0 THEN least(100, greatest(0, 50 + tone_score)) END AS disclosure_score FROM rk),
fs0 AS (
    SELECT *, {" + ".join(f"coalesce({k}_score * {w}::DOUBLE, 0::DOUBLE)" for k, w in a.WEIGHTS.items())} AS top,
           {" + ".join(f"CASE WHEN {k}_score IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for k, w in a.WEIGHTS.items())} AS wt,
           (coalesce(fundamentals_confidence, 0) + coalesce(valuation_confidence, 0) + coalesce(confidence, 0) + coalesce(disclosure_confidence, 0) + coalesce(risk_confidence, 0)) / 5 AS score_confidence FROM sb),
fs AS (SELECT *, CASE WHEN wt > 0 THEN least(100, greatest(0, top / wt - coalesce(risk_score, 0) * 0.1::DOUBLE)) END AS final_score FROM fs0)"""
REL = f"""
re0 AS (
    SELECT *, CAST({" + ".join(f"CASE WHEN {c} > 0 THEN 20 ELSE 0 END" for c in ("fundamentals_confidence", "valuation_confidence", "confidence", "disclosure_confidence", "risk_confidence"))} AS DOUBLE) AS coverage,
           {count_sql(*[f"{k}_score" for k in a.WEIGHTS])} AS n_subscores FROM fs),
re1 AS (SELECT *, round(final_score * score_confidence / 100 * coverage / 100, 1) AS screening_score, coalesce(final_score IS NOT NULL AND score_confidence >= 30 AND coverage >= 40 AND n_subscores >= 2, FALSE) AS eligible FROM re0),
re AS (SELECT *, CASE WHEN NOT eligible THEN 'insufficient' WHEN score_confidence >= 70 AND coverage >= 80 THEN 'high' WHEN score_confidence >= 50 THEN 'medium' ELSE 'low' END AS grade FROM re1)"""
BASE = f"WITH {v.BARS}, {v.STATEMENTS}, {v.COMPANIES}, {v.DISCLOSURES}, {MOM}, {FUND}, {VAL}, {TONE}, {ALL}, {REL}"


#: Places kept of quotients of prices, and of large amounts; six otherwise.
PLACES = {"price": 8, "last_close": 8, "market_cap": 3}


def rounded(df, names):
    return df.withColumns({c: F.round(c, PLACES.get(c, 6)) for c in names})


def rsql(names) -> str:
    return ", ".join(f"round({c}, {PLACES.get(c, 6)}) AS {c}" for c in names)


def _mom(spark, sf_dir):
    return t.momentum(v.bars(spark, sf_dir))


def bundle(spark, sf_dir):
    """Everything known of each ticker that has bars or statements, one row."""
    mom = _mom(spark, sf_dir)
    d = a.valuation(a.fundamentals(v.statements(spark, sf_dir)), mom).join(mom, "ticker", "full_outer")
    d = d.join(a.tone(v.disclosures(spark, sf_dir), v.lexicon(spark)), "ticker", "left").join(v.companies(spark, sf_dir).select("ticker", "sector", "company_name"), "ticker", "left")
    return a.reliability(a.scores(a.risk_flags(d)))


@query(f"WITH {v.STATEMENTS}, {FUND} SELECT ticker, fiscal_year, {rsql([*a.FUNDAMENTAL, 'fundamentals_confidence'])} FROM fu")
def fundamentals_metrics(spark, sf_dir):
    names = [*a.FUNDAMENTAL, "fundamentals_confidence"]
    return rounded(a.fundamentals(v.statements(spark, sf_dir)), names).select("ticker", "fiscal_year", *names)


MULTIPLES = ["price", "per", "pbr", "psr", "peg", "dividend_yield", "market_cap", "valuation_confidence"]


@query(f"WITH {v.BARS}, {v.STATEMENTS}, {MOM}, {FUND}, {VAL} SELECT ticker, valuation_class, {rsql(MULTIPLES)} FROM va")
def valuation_metrics(spark, sf_dir):
    return rounded(a.valuation(a.fundamentals(v.statements(spark, sf_dir)), _mom(spark, sf_dir)), MULTIPLES).select("ticker", "valuation_class", *MULTIPLES)


MOMENTS = ["last_close", "ret_1m", "ret_3m", "ret_6m", "ret_12m", "ma_20", "ma_60", "ma_120", "ma_200", "volatility", "max_drawdown", "confidence"]


@query(f"WITH {v.BARS}, {MOM} SELECT ticker, analysis_date, n_bars, volume_trend, {rsql(MOMENTS)} FROM mo")
def momentum_metrics(spark, sf_dir):
    return rounded(_mom(spark, sf_dir), MOMENTS).select("ticker", "analysis_date", "n_bars", "volume_trend", *MOMENTS)


@query(f"WITH {v.DISCLOSURES}, {TONE} SELECT ticker, rule_id, category, CAST(sentence_no AS INTEGER) AS sentence_no, evidence, severity, CAST(confidence AS DOUBLE) AS confidence FROM fi")
def disclosure_findings(spark, sf_dir):
    return a.findings(v.disclosures(spark, sf_dir), v.lexicon(spark)).select("ticker", "rule_id", "category", "sentence_no", "evidence", "severity", "confidence")


@query(f"WITH {v.DISCLOSURES}, {TONE} SELECT ticker, n_findings, CAST(tone_score AS DOUBLE) AS tone_score, {', '.join(f'n_{c}' for c in a.COUNTED)}, has_critical, CAST(disclosure_confidence AS DOUBLE) AS disclosure_confidence FROM tn")
def tone_score(spark, sf_dir):
    return a.tone(v.disclosures(spark, sf_dir), v.lexicon(spark))


@query(f"WITH {v.DISCLOSURES}, {v.LEXICON_SQL} SELECT ticker, category, CAST(sum((length(text) - length(replace(text, keyword, ''))) // length(keyword)) AS BIGINT) AS n FROM disclosures, lexicon GROUP BY 1, 2")
def keyword_counts(spark, sf_dir):
    return a.keyword_counts(v.disclosures(spark, sf_dir), v.lexicon(spark))


@query(f"{BASE} SELECT ticker, CAST(n_flags AS INTEGER) AS n_flags, risk_score, risk_confidence, has_critical_flag FROM re")
def risk_flags(spark, sf_dir):
    return bundle(spark, sf_dir).select("ticker", F.size("risk_flags").alias("n_flags"), "risk_score", "risk_confidence", "has_critical_flag")


SUBS = [f"{k}_score" for k in a.WEIGHTS] + ["final_score", "score_confidence"]


@query(f"{BASE} SELECT ticker, {rsql(SUBS)} FROM re")
def final_scores(spark, sf_dir):
    return rounded(bundle(spark, sf_dir), SUBS).select("ticker", *SUBS)


def _pct(m: str, up: bool) -> str:
    order = "ASC" if up else "DESC"
    return f"CASE WHEN sector IS NOT NULL AND {m} IS NOT NULL THEN (rank() OVER (PARTITION BY sector ORDER BY {m} {order} NULLS LAST) + (count(*) OVER (PARTITION BY sector, {m}) - 1) / 2.0::DOUBLE - 1) / nullif(count({m}) OVER (PARTITION BY sector) - 1, 0) * 100 END AS pct_{m}"


PCT = [f"pct_{m}" for m, _ in a.SECTOR_METRICS]


@query(f"""{BASE}, x AS (SELECT *, coalesce(ret_3m, ret_6m) AS ret FROM re),
    p AS (SELECT ticker, sector, count(*) OVER (PARTITION BY sector) AS names, {", ".join(_pct(m, up) for m, up in a.SECTOR_METRICS)} FROM x),
    s AS (SELECT *, CASE WHEN sector IS NOT NULL AND names >= 2 THEN {mean_sql(*[f"round({c}, 1)" for c in PCT])} END AS sector_relative_score,
                 CASE WHEN sector IS NOT NULL AND names >= 2 THEN {count_sql(*PCT)} / {len(PCT)}.0::DOUBLE * least(1.0::DOUBLE, names / 4.0::DOUBLE) * 100 END AS sector_confidence FROM p)
    SELECT ticker, sector, CASE WHEN sector IS NOT NULL THEN names END AS sector_size, {rsql([*PCT, "sector_confidence"])}, round(sector_relative_score, 4) AS sector_relative_score FROM s""")
def sector_percentiles(spark, sf_dir):
    d = a.sector_relative(bundle(spark, sf_dir))
    return rounded(d, [*PCT, "sector_confidence"]).withColumn("sector_relative_score", F.round("sector_relative_score", 4)).select("ticker", "sector", "sector_size", *PCT, "sector_confidence", "sector_relative_score")


@query(f"""{BASE} SELECT ticker, coverage, screening_score, eligible, grade,
    CASE WHEN final_score IS NULL OR score_confidence < 30 THEN 'insufficient_data' WHEN final_score >= 80 THEN 'strong_candidate' WHEN final_score >= 65 THEN 'candidate' WHEN final_score >= 50 THEN 'watchlist' WHEN final_score <= 35 THEN 'avoid' ELSE 'watchlist' END AS label,
    CAST(row_number() OVER (ORDER BY eligible DESC, screening_score DESC NULLS LAST, round(final_score, 6) DESC NULLS LAST, ticker) AS INTEGER) AS rank FROM re""")
def reliability_screening(spark, sf_dir):
    return a.screening(bundle(spark, sf_dir).withColumn("final_score", r6("final_score"))).select("ticker", "coverage", "screening_score", "eligible", "grade", "label", "rank")


@query(f"""{BASE}, g AS (SELECT *, {" + ".join(f"CASE WHEN {k}_score >= 60 THEN 1 ELSE 0 END" for k in ("quality", "growth", "momentum", "disclosure"))} + CASE WHEN n_positive >= 2 THEN 1 ELSE 0 END AS n_support FROM re)
    SELECT ticker, n_support, CASE WHEN final_score IS NULL OR score_confidence < 55 THEN 'insufficient_data' WHEN final_score <= 35 OR (has_critical_flag AND final_score < 65) THEN 'sell_candidate'
        WHEN has_critical_flag OR risk_score >= 70 THEN 'avoid' WHEN final_score >= 78 AND risk_score <= 45 AND n_support >= 2 THEN 'buy_candidate' WHEN final_score >= 65 THEN 'watch' WHEN risk_score >= 60 THEN 'avoid' ELSE 'hold' END AS signal FROM g""")
def research_signals(spark, sf_dir):
    return a.signals(bundle(spark, sf_dir)).select("ticker", "n_support", "signal")
