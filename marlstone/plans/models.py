"""Queries over the point-in-time dataset: scores, their evaluation, portfolios, monitoring."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.semantics import r6
from ..operators import modeling as m
from ..operators import portfolio as pf
from ..operators import timeseries as t
from ..sources import views as v
from ..sources.scratch import written
from .base import query

W = "(PARTITION BY ticker ORDER BY date)"
UPTO = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
RISK_WORDS = ["thanea", "ertion"]
H = v.HORIZONS
LABEL = "forward_return_h20"

DATASET = f"""
pb0 AS (SELECT ticker, date, adj_close AS p, adj_close / nullif(lag(adj_close) OVER {W}, 0) - 1 AS ret, least(0, adj_close / nullif(max(adj_close) OVER {UPTO}, 0) - 1) AS dd,
               {", ".join(f"(adj_close / nullif(lag(adj_close, {k}) OVER {W}, 0) - 1) * 100 AS momentum_{k}d" for k in (20, 60, 120))} FROM bars),
pb AS (SELECT *, CASE WHEN count(*) OVER {UPTO} >= 3 THEN stddev_samp(ret) OVER {UPTO} * sqrt(252.0::DOUBLE) * 100 END AS volatility, min(dd) OVER {UPTO} * 100 AS max_drawdown FROM pb0),
pf AS (SELECT decision_date, ticker, p AS market_price, momentum_20d, momentum_60d, momentum_120d, volatility, max_drawdown FROM pb JOIN dates ON date <= decision_date
       QUALIFY row_number() OVER (PARTITION BY decision_date, ticker ORDER BY date DESC) = 1),
sa0 AS (SELECT decision_date, s.*, lead(revenue) OVER w AS prior_revenue, lead(net_income) OVER w AS prior_net_income, row_number() OVER w AS k
        FROM statements s JOIN dates ON disclosure_date <= decision_date WINDOW w AS (PARTITION BY decision_date, ticker ORDER BY fiscal_year DESC NULLS FIRST, fiscal_period DESC)),
sa AS (SELECT * FROM sa0 WHERE k = 1),
ba AS (SELECT ticker, CASE WHEN count(DISTINCT accounting_basis) > 1 THEN 'mixed' ELSE min(accounting_basis) END AS basis FROM statements GROUP BY 1),
un AS (SELECT ticker FROM bars UNION SELECT ticker FROM statements UNION SELECT ticker FROM companies),
lb0 AS (SELECT ticker, date, adj_close AS p0, lag(date) OVER {W} AS before, {", ".join(f"lead(adj_close, {h}) OVER {W} AS l{h}" for h in H)} FROM bars),
lb AS (SELECT decision_date, ticker, {", ".join(f"(l{h} / nullif(p0, 0) - 1) * 100 AS forward_return_h{h}" for h in H)} FROM lb0 JOIN dates ON date > decision_date AND (before IS NULL OR before <= decision_date)),
tx AS (SELECT ticker, CASE WHEN text IS NOT NULL THEN CAST(length(text) > 0 AS DOUBLE) END AS narrative_available,
              CASE WHEN length(text) > 0 THEN CAST({" + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in RISK_WORDS)} AS DOUBLE) END AS risk_keyword_count,
              CASE WHEN length(text) > 0 THEN 0.0::DOUBLE END AS sentiment_placeholder FROM disclosures),
ds AS (
    SELECT d.decision_date, u.ticker, sector, basis,
           CASE WHEN basis IS NULL THEN 'no_fundamentals' WHEN sa.disclosure_date IS NULL THEN 'disclosure_after_decision' WHEN basis = 'non_consolidated' THEN 'non_consolidated_basis' ELSE '' END AS exclusion,
           net_income / nullif(market_price * nullif(shares_outstanding, 0), 0) * 100 AS earnings_yield, equity / nullif(market_price * nullif(shares_outstanding, 0), 0) AS book_to_market,
           revenue / nullif(market_price * nullif(shares_outstanding, 0), 0) AS sales_to_price, net_income / nullif(equity, 0) * 100 AS roe, net_income / nullif(total_assets, 0) * 100 AS roa,
           operating_income / nullif(revenue, 0) * 100 AS operating_margin, equity / nullif(total_assets, 0) * 100 AS equity_ratio,
           (revenue - prior_revenue) / nullif(prior_revenue, 0) * 100 AS revenue_growth_yoy, (net_income - prior_net_income) / nullif(prior_net_income, 0) * 100 AS net_income_growth_yoy,
           momentum_20d, momentum_60d, momentum_120d, volatility, max_drawdown, total_assets / nullif(equity, 0) AS leverage, narrative_available, risk_keyword_count, sentiment_placeholder,
           {", ".join(f"forward_return_h{h}" for h in H)}
    FROM un u CROSS JOIN dates d LEFT JOIN sa ON sa.ticker = u.ticker AND sa.decision_date = d.decision_date LEFT JOIN pf ON pf.ticker = u.ticker AND pf.decision_date = d.decision_date
    LEFT JOIN companies c ON c.ticker = u.ticker LEFT JOIN ba ON ba.ticker = u.ticker LEFT JOIN tx ON tx.ticker = u.ticker LEFT JOIN lb ON lb.ticker = u.ticker AND lb.decision_date = d.decision_date),
ok AS (SELECT * FROM ds WHERE exclusion = '')"""
NORMAL = f"""
ln AS ({" UNION ALL ".join(f"SELECT decision_date, ticker, sector, '{f}' AS factor, {'-' if f in m.LESS_IS_BETTER else ''}{f} AS raw FROM ok" for f in m.FACTORS)}),
wq AS (SELECT *, quantile_cont(raw, 0.05) OVER w AS q1, quantile_cont(raw, 0.95) OVER w AS q2, count(raw) OVER w AS n FROM ln WINDOW w AS (PARTITION BY decision_date, factor)),
wx AS (SELECT decision_date, ticker, sector, factor, CASE WHEN raw IS NULL THEN NULL WHEN n < 2 THEN raw ELSE least(greatest(raw, q1), q2) END AS x FROM wq),
wz AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN count(x) OVER w < 2 OR coalesce(stddev_samp(x) OVER w, 0) < 1e-12 THEN 0 ELSE (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z,
              CASE WHEN x IS NULL THEN NULL WHEN sector IS NULL THEN 0 WHEN count(x) OVER ws < 2 OR coalesce(stddev_samp(x) OVER ws, 0) < 1e-12 THEN 0 ELSE (x - avg(x) OVER ws) / nullif(stddev_samp(x) OVER ws, 0) END AS sector_z
       FROM wx WINDOW w AS (PARTITION BY decision_date, factor), ws AS (PARTITION BY decision_date, factor, sector))"""


def _mean(xs):
    top = " + ".join(f"coalesce({x}, 0::DOUBLE)" for x in xs)
    return f"(({top}) / nullif({' + '.join(f'CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END' for x in xs)}, 0))"


SCORES = f"""
wd AS (SELECT decision_date, ticker, {", ".join(f"max(z) FILTER (factor = '{f}') AS z_{f}" for f in m.FACTORS)} FROM wz GROUP BY 1, 2),
gm AS (SELECT decision_date, ticker, {", ".join(f"{_mean([f'z_{f}' for f in fs])} AS g_{g}" for g, fs in m.GROUPS.items())} FROM wd),
sc0 AS (SELECT decision_date, ticker, round({_mean([f'g_{g}' for g in m.GROUPS])}, 9) AS score, {" + ".join(f"CASE WHEN g_{g} IS NOT NULL THEN 1 ELSE 0 END" for g in m.GROUPS)} AS n_groups FROM gm),
sc AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY decision_date ORDER BY score DESC NULLS LAST, ticker) END AS rank_desc FROM sc0),
sd AS (SELECT sc.*, sector, {", ".join(f"round(forward_return_h{h}, 9) AS forward_return_h{h}" for h in H)} FROM sc JOIN ok USING (decision_date, ticker)),
al AS (SELECT decision_date, ticker, round(momentum_60d, 9) AS score FROM ok)"""
BASE = f"WITH {v.BARS}, {v.STATEMENTS}, {v.COMPANIES}, {v.DISCLOSURES}, {v.DATES_SQL}, {DATASET}"
FULL = f"{BASE}, {NORMAL}, {SCORES}"


def _rank(c: str, keys: str = "decision_date") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    both = f"PARTITION BY {keys}, {c}" if keys else f"PARTITION BY {c}"
    return f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE)"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND var_pop({x}) > 1e-12 AND var_pop({y}) > 1e-12 THEN (avg({x} * {y}) - avg({x}) * avg({y})) / sqrt(var_pop({x}) * var_pop({y})) END"


IC = f"""
ip AS (SELECT decision_date, sector, score, {LABEL} AS y FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL),
iq AS (SELECT *, round(score - avg(score) OVER w, 9) AS s_d, round(y - avg(y) OVER w, 9) AS y_d FROM ip WINDOW w AS (PARTITION BY decision_date, sector)),
ir AS (SELECT decision_date, {", ".join(f"{_rank(c)} AS r_{c}" for c in ("score", "y", "s_d", "y_d"))} FROM iq),
ic AS (SELECT decision_date, count(*) AS n, {_corr("r_score", "r_y")} AS ic, {_corr("r_s_d", "r_y_d")} AS sector_neutral_ic FROM ir GROUP BY 1)"""
QUANT = f"""
qa AS (SELECT decision_date, score, {LABEL} AS y, count(*) OVER w AS n, median({LABEL}) OVER w AS med FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL WINDOW w AS (PARTITION BY decision_date)),
qb AS (SELECT decision_date, CAST(least(4, floor(({_rank("score")} - 1) / n * 5)) AS INTEGER) AS bucket, y, med FROM qa WHERE n >= 5),
qc AS (SELECT decision_date, bucket, avg(y) AS mean_label, max(med) AS med FROM qb GROUP BY 1, 2)"""
POS = f"""
pa AS (SELECT decision_date, ticker, sector, score, {LABEL} AS ret, count(*) OVER (PARTITION BY decision_date) AS universe, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker DESC) AS rn
       FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL),
pc AS (SELECT *, greatest(1, CAST(floor(universe * 0.2::DOUBLE) AS BIGINT)) AS k FROM pa),
ps AS (SELECT decision_date, ticker, sector, CASE WHEN rn <= k THEN 'long' ELSE 'short' END AS leg, 1.0::DOUBLE / k AS weight, ret, universe FROM pc WHERE (rn <= k OR universe - rn + 1 <= k) AND 2 * k <= universe),
sp AS (SELECT decision_date, 'ok' AS status, max(universe) AS universe, count(*) FILTER (leg = 'long') AS n_long, count(*) FILTER (leg = 'short') AS n_short,
              sum(weight * ret) FILTER (leg = 'long') AS long_return, sum(weight * ret) FILTER (leg = 'short') AS short_return,
              sum(weight * ret) FILTER (leg = 'long') - sum(weight * ret) FILTER (leg = 'short') AS spread FROM ps GROUP BY 1)"""


def ds(spark, sf_dir):
    return m.dataset(v.bars(spark, sf_dir), v.statements(spark, sf_dir), v.companies(spark, sf_dir), v.disclosures(spark, sf_dir), v.decision_dates(spark), RISK_WORDS, H)


def included(spark, sf_dir):
    """The rows without reason of exclusion, written once: what follows reads them several times."""
    return written(ds(spark, sf_dir).where("exclusion = ''"))[0]


def scored(spark, sf_dir):
    """Baseline scores with sector and labels, written once: evaluations read them several times."""
    return scored_of(included(spark, sf_dir))


def scored_of(d):
    s = m.baseline_scores(d)
    return written(s.join(d.select("decision_date", "ticker", "sector", *[F.round(f"forward_return_h{h}", 9).alias(f"forward_return_h{h}") for h in H]), ["decision_date", "ticker"]))[0]


def alternative_of(d):
    return d.select("decision_date", "ticker", F.round("momentum_60d", 9).alias("score"))


def rounded(df, *names):
    return df.withColumns({c: r6(c) for c in names})


def rsql(*names):
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


LABELS = [f"forward_return_h{h}" for h in H]


@query(f"{BASE} SELECT decision_date, ticker, sector, basis, exclusion, {rsql(*m.FACTORS, *LABELS)} FROM ds")
def modeling_dataset(spark, sf_dir):
    return rounded(ds(spark, sf_dir), *m.FACTORS, *LABELS)


@query(f"{BASE} SELECT decision_date, exclusion, basis, count(*) AS n, count({LABEL}) AS n_labelled, count(momentum_120d) AS n_momentum_120d FROM ds GROUP BY 1, 2, 3")
def dataset_coverage(spark, sf_dir):
    return ds(spark, sf_dir).groupBy("decision_date", "exclusion", "basis").agg(F.count("*").alias("n"), F.count(LABEL).alias("n_labelled"), F.count("momentum_120d").alias("n_momentum_120d"))


@query(f"""{BASE} SELECT decision_date, ticker, {", ".join(f"round(forward_return_h{h} - CASE WHEN sector IS NOT NULL AND count(forward_return_h{h}) OVER ws >= 2 THEN avg(forward_return_h{h}) OVER ws ELSE avg(forward_return_h{h}) OVER w END, 6) AS excess_return_h{h}" for h in H)}
    FROM ok WINDOW w AS (PARTITION BY decision_date), ws AS (PARTITION BY decision_date, sector)""")
def excess_returns(spark, sf_dir):
    names = [f"excess_return_h{h}" for h in H]
    return rounded(m.excess_returns(included(spark, sf_dir), H), *names).select("decision_date", "ticker", *names)


@query(f"{BASE}, {NORMAL} SELECT decision_date, ticker, factor, {rsql('x', 'z', 'sector_z')} FROM wz")
def winsor_z(spark, sf_dir):
    return rounded(m.normalised(included(spark, sf_dir)), "x", "z", "sector_z").select("decision_date", "ticker", "factor", "x", "z", "sector_z")


@query(f"{FULL} SELECT decision_date, ticker, round(score, 6) AS score, n_groups, CAST(rank_desc AS INTEGER) AS rank_desc FROM sc")
def baseline_scores(spark, sf_dir):
    return rounded(m.baseline_scores(included(spark, sf_dir)), "score")


@query(f"{FULL}, {IC} SELECT decision_date, n, {rsql('ic', 'sector_neutral_ic')} FROM ic")
def rank_ic(spark, sf_dir):
    return rounded(m.rank_ic(scored(spark, sf_dir), LABEL), "ic", "sector_neutral_ic")


@query(f"{FULL}, {IC} SELECT count(*) AS n_dates, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg(sector_neutral_ic), 6) AS sector_neutral_ic_mean FROM ic")
def icir(spark, sf_dir):
    return rounded(m.ic_summary(m.rank_ic(scored(spark, sf_dir), LABEL)), "ic_mean", "ic_std", "icir", "sector_neutral_ic_mean")


@query(f"{FULL}, {QUANT} SELECT bucket, round(avg(mean_label), 6) AS mean_label, count(*) AS n_dates FROM qc GROUP BY 1")
def quantile_table(spark, sf_dir):
    return rounded(m.quantile_table(scored(spark, sf_dir), LABEL), "mean_label")


@query(f"""{FULL}, {QUANT}, d AS (SELECT decision_date, max(mean_label) FILTER (bucket = 4) AS top, max(mean_label) FILTER (bucket = 0) AS bottom, max(med) AS med FROM qc GROUP BY 1)
    SELECT count(*) AS n_dates, round(avg(top - bottom), 6) AS spread_mean, round(count(*) FILTER (top > 0) / count(*), 6) AS hit_positive, round(count(*) FILTER (top > med) / count(*), 6) AS hit_above_median FROM d""")
def quantile_summary(spark, sf_dir):
    return rounded(m.quantile_summary(scored(spark, sf_dir), LABEL), "spread_mean", "hit_positive", "hit_above_median")


@query(f"{FULL}, {POS} SELECT decision_date, status, universe, n_long, n_short, {rsql('long_return', 'short_return', 'spread')} FROM sp")
def long_short_spread(spark, sf_dir):
    return rounded(pf.date_spreads(scored(spark, sf_dir), LABEL), "long_return", "short_return", "spread")


@query(f"""{FULL}, {POS}, e AS (SELECT decision_date, product(1 + spread / 100) OVER (ORDER BY decision_date) AS equity FROM sp),
    p AS (SELECT *, greatest(1, max(equity) OVER (ORDER BY decision_date)) AS peak FROM e)
    SELECT decision_date, {rsql('equity', 'peak')}, round((equity / peak - 1) * 100, 6) AS drawdown FROM p""")
def equity_curve(spark, sf_dir):
    return rounded(pf.equity_curve(pf.date_spreads(scored(spark, sf_dir), LABEL)), "equity", "peak", "drawdown")


@query(f"""{FULL}, {POS} SELECT count(*) AS n_periods, round(avg(spread), 6) AS mean_spread, round(stddev_samp(spread), 6) AS std_spread, round(avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(12.0::DOUBLE), 6) AS sharpe_like,
    round(avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, arg_min(decision_date, spread) AS worst_period, arg_max(decision_date, spread) AS best_period FROM sp""")
def spread_summary(spark, sf_dir):
    return rounded(pf.spread_summary(pf.date_spreads(scored(spark, sf_dir), LABEL)), "mean_spread", "std_spread", "sharpe_like", "hit_rate")


TURN = """
dt AS (SELECT decision_date, lead(decision_date) OVER (ORDER BY decision_date) AS nxt FROM (SELECT DISTINCT decision_date FROM ps)),
bf AS (SELECT nxt AS decision_date, ticker, leg, weight AS was FROM ps JOIN dt USING (decision_date) WHERE nxt IS NOT NULL),
nw AS (SELECT decision_date, ticker, leg, weight FROM ps WHERE decision_date IN (SELECT nxt FROM dt WHERE nxt IS NOT NULL)),
ch AS (SELECT decision_date, leg, abs(coalesce(weight, 0) - coalesce(was, 0)) / 2 AS c FROM nw FULL OUTER JOIN bf USING (decision_date, ticker, leg)),
tu AS (SELECT decision_date, sum(CASE WHEN leg = 'long' THEN c ELSE 0 END) AS long_turnover, sum(CASE WHEN leg = 'short' THEN c ELSE 0 END) AS short_turnover FROM ch GROUP BY 1)"""


@query(f"{FULL}, {POS}, {TURN} SELECT decision_date, {rsql('long_turnover', 'short_turnover')}, round(long_turnover + short_turnover, 6) AS turnover FROM tu")
def turnover(spark, sf_dir):
    return rounded(pf.turnover(pf.positions(scored(spark, sf_dir), LABEL)), "long_turnover", "short_turnover", "turnover")


@query(f"""{FULL}, {POS}, {TURN} SELECT decision_date, round(spread, 6) AS gross, round(coalesce(long_turnover + short_turnover, 0) * 10 / 100, 6) AS cost, round(spread - coalesce(long_turnover + short_turnover, 0) * 10 / 100, 6) AS net FROM sp LEFT JOIN tu USING (decision_date)""")
def net_cost(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(pf.net_of_cost(pf.date_spreads(s, LABEL), pf.turnover(pf.positions(s, LABEL)), 10.0), "gross", "cost", "net")


@query(f"{FULL}, {POS} SELECT decision_date, leg, round(sum(weight * weight), 6) AS hhi, round(max(weight), 6) AS top_weight, round(1 / sum(weight * weight), 6) AS effective_n FROM ps GROUP BY 1, 2")
def concentration(spark, sf_dir):
    return rounded(pf.concentration(pf.positions(scored(spark, sf_dir), LABEL)), "hhi", "top_weight", "effective_n")


@query(f"{FULL}, {POS} SELECT leg, sector, round(sum(weight) / (SELECT count(DISTINCT decision_date) FROM ps), 6) AS exposure FROM ps GROUP BY 1, 2")
def sector_exposure(spark, sf_dir):
    return rounded(pf.sector_exposure(pf.positions(scored(spark, sf_dir), LABEL)), "exposure")


@query(f"""{FULL}, {POS}, u AS (SELECT decision_date, avg({LABEL}) AS u FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL GROUP BY 1),
    s AS (SELECT decision_date, sector, avg({LABEL}) AS s FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL AND sector IS NOT NULL GROUP BY 1, 2)
    SELECT decision_date, leg, round(sum(weight * (ret - u)), 6) AS excess_universe, round(sum(weight * (ret - coalesce(s, u))), 6) AS excess_sector FROM ps JOIN u USING (decision_date) LEFT JOIN s USING (decision_date, sector) GROUP BY 1, 2""")
def leg_excess(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(pf.leg_excess(pf.positions(s, LABEL), s, LABEL), "excess_universe", "excess_sector")


COMMON = "cm AS (SELECT sc.decision_date, sc.ticker, sc.score AS a, al.score AS b FROM sc JOIN al USING (decision_date, ticker) WHERE sc.score IS NOT NULL AND al.score IS NOT NULL)"


def _models(spark, sf_dir):
    d = included(spark, sf_dir)
    return {"baseline": written(m.baseline_scores(d))[0], "momentum": alternative_of(d)}


@query(f"{FULL}, {COMMON} SELECT decision_date, ticker, round(({_rank('a')} + {_rank('b')}) / 2, 6) AS score FROM cm")
def rank_ensemble(spark, sf_dir):
    return rounded(m.rank_average(_models(spark, sf_dir)), "score")


@query(f"""{FULL}, {COMMON} SELECT decision_date, ticker, round((a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) * 0.75::DOUBLE + (b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0) * 0.25::DOUBLE, 6) AS score FROM cm WINDOW w AS (PARTITION BY decision_date)""")
def weighted_blend(spark, sf_dir):
    return rounded(m.weighted_blend(_models(spark, sf_dir), {"baseline": 3.0, "momentum": 1.0}), "score")


@query(f"{FULL}, {COMMON}, r AS (SELECT {_rank('a', '')} AS ra, {_rank('b', '')} AS rb FROM cm) SELECT 'baseline|momentum' AS pair, round({_corr('ra', 'rb')}, 6) AS corr FROM r")
def pairwise_corr(spark, sf_dir):
    return rounded(m.pairwise_corr(_models(spark, sf_dir)), "corr")


@query(f"""{FULL}, j AS (SELECT sd.decision_date, sd.score AS s, al.score AS b, {LABEL} AS y FROM sd JOIN al USING (decision_date, ticker) WHERE sd.score IS NOT NULL AND al.score IS NOT NULL AND {LABEL} IS NOT NULL),
    k AS (SELECT *, round(s - avg(s) OVER w - coalesce((avg(s * b) OVER w - avg(s) OVER w * avg(b) OVER w) / nullif(var_pop(b) OVER w, 0), 0) * (b - avg(b) OVER w), 8) AS rest FROM j WINDOW w AS (PARTITION BY decision_date)),
    r AS (SELECT decision_date, {_rank('s')} AS rs, {_rank('rest')} AS rr, {_rank('y')} AS ry FROM k),
    c AS (SELECT decision_date, {_corr('rs', 'ry')} AS ic_raw, {_corr('rr', 'ry')} AS ic_neutral FROM r GROUP BY 1)
    SELECT decision_date, {rsql('ic_raw', 'ic_neutral')}, round(ic_neutral - ic_raw, 6) AS delta FROM c""")
def model_contribution(spark, sf_dir):
    d = included(spark, sf_dir)
    return rounded(m.contribution(scored_of(d), alternative_of(d), LABEL), "ic_raw", "ic_neutral", "delta")


MONTHS = """
mo AS (SELECT 'turnover' AS metric, CAST(date_trunc('month', date) AS DATE) AS date, avg(turnover_value) AS value FROM bars GROUP BY 2),
mv AS (SELECT metric, date, CASE WHEN month(date) = 7 THEN NULL ELSE value END AS value FROM mo)"""


def _months(spark, sf_dir):
    b = v.bars(spark, sf_dir).groupBy(F.trunc("date", "month").alias("date")).agg(F.avg("turnover_value").alias("value"))
    return b.select(F.lit("turnover").alias("metric"), "date", F.when(F.month("date") != 7, F.col("value")).alias("value"))


@query(f"""WITH {v.BARS}, {MONTHS}, k AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std FROM mv WHERE value IS NOT NULL WINDOW w AS (PARTITION BY metric ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT metric, date, round(value, 4) AS value, round(CASE WHEN n >= 3 THEN mean END, 4) AS mean, round(CASE WHEN n >= 3 THEN std END, 4) AS std, round(CASE WHEN n >= 3 THEN (value - mean) / nullif(std, 0) END, 6) AS z,
           CASE WHEN n < 3 THEN 'insufficient_history' WHEN abs((value - mean) / nullif(std, 0)) > 2 THEN 'drift' ELSE 'ok' END AS flag FROM k
    UNION ALL SELECT metric, date, NULL, NULL, NULL, NULL, 'missing' FROM mv WHERE value IS NULL""")
def monitoring_z(spark, sf_dir):
    return pf.monitor(_months(spark, sf_dir)).withColumns({"value": F.round("value", 4), "mean": F.round("mean", 4), "std": F.round("std", 4), "z": r6("z")})


@query(f"""WITH {v.BARS}, {MONTHS} SELECT metric, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(stddev_samp(value) / nullif(abs(avg(value)), 0), 6) AS cv, 1.0::DOUBLE AS positive_rate FROM mv WHERE value IS NOT NULL GROUP BY 1""")
def metric_stability(spark, sf_dir):
    return pf.stability(_months(spark, sf_dir)).withColumns({**{c: F.round(c, 4) for c in ("mean", "std", "min", "max")}, "cv": r6("cv")})


@query(f"""WITH {v.BARS}, d AS (SELECT date AS decision_date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS date FROM bars)),
    f AS (SELECT unnest(range(0, (SELECT count(*) FROM d) - 4)) AS fold)
    SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN i < 4 + fold THEN 'train' ELSE 'test' END AS role, decision_date FROM d, f WHERE i < 5 + fold""")
def walk_forward_folds(spark, sf_dir):
    d = v.bars(spark, sf_dir).select(F.trunc("date", "year").alias("decision_date"))
    return pf.walk_forward(spark, d, min_train=4)


@query(f"""WITH {v.BARS}, b AS (SELECT ticker, date AS start, lead(date, 20) OVER {W} AS "end" FROM bars), k AS (SELECT * FROM b WHERE "end" IS NOT NULL)
    SELECT CASE WHEN start <= DATE '1998-03-31' AND "end" >= DATE '1998-01-01' THEN 'purged' WHEN start > DATE '1998-03-31' AND start <= DATE '1998-03-31' + 30 THEN 'embargoed' ELSE 'kept' END AS outcome, count(*) AS n FROM k GROUP BY 1""")
def purge_embargo(spark, sf_dir):
    b = v.bars(spark, sf_dir).select("ticker", F.col("date").alias("start"), F.lead("date", 20).over(t.by_date()).alias("end")).where("end IS NOT NULL")
    return pf.purge_embargo(b, datetime.date(1998, 1, 1), datetime.date(1998, 3, 31), 30).groupBy("outcome").agg(F.count("*").alias("n"))
