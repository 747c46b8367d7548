"""Queries over bars: features, quality, point-in-time returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import r6
from ..operators import quality as q
from ..operators import timeseries as t
from ..sources import views as v
from .base import query

W = "(PARTITION BY ticker ORDER BY date)"
ROLL = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
FEATURES = f"""
f0 AS (
    SELECT *, adj_close / nullif(lag(adj_close, 1) OVER {W}, 0) - 1 AS ret_1d,
           adj_close / nullif(lag(adj_close, 5) OVER {W}, 0) - 1 AS ret_5d,
           adj_close / nullif(lag(adj_close, 20) OVER {W}, 0) - 1 AS ret_20d,
           adj_open / nullif(lag(adj_close, 1) OVER {W}, 0) - 1 AS overnight_gap,
           adj_close / nullif(adj_open, 0) - 1 AS intraday_return, adj_high / nullif(adj_low, 0) - 1 AS range_pct,
           count(*) OVER (PARTITION BY ticker) AS n_rows
    FROM bars),
f AS (
    SELECT *, CASE WHEN count(ret_1d) OVER {ROLL} >= 20 THEN stddev_samp(ret_1d) OVER {ROLL} END AS volatility_20d,
           CASE WHEN count(volume) OVER {ROLL} >= 20 THEN avg(volume) OVER {ROLL} END AS avg_volume_20d,
           CASE WHEN count(turnover_value) OVER {ROLL} >= 20 THEN avg(turnover_value) OVER {ROLL} END AS avg_turnover_20d
    FROM f0 WHERE n_rows >= 21)"""
MEASURES = ("ret_1d", "ret_5d", "ret_20d", "overnight_gap", "intraday_return", "range_pct", "volatility_20d", "avg_volume_20d", "avg_turnover_20d")


@query(f"""WITH {v.BARS}, {v.COMPANIES}, {FEATURES}
    SELECT f.ticker, f.date, sector, {", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)}
    FROM f LEFT JOIN companies USING (ticker)""")
def daily_bar_features(spark, sf_dir):
    f = t.daily_features(v.bars(spark, sf_dir))
    return f.join(v.companies(spark, sf_dir).select("ticker", "sector"), "ticker", "left").select("ticker", "date", "sector", *[r6(m).alias(m) for m in MEASURES])


@query(f"""WITH {v.BARS}, {FEATURES}
    SELECT ticker, date,
           CASE WHEN avg_turnover_20d IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY round(avg_turnover_20d, 4) DESC NULLS LAST) END AS turnover_rank,
           CASE WHEN avg_volume_20d IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY round(avg_volume_20d, 4) DESC NULLS LAST) END AS volume_rank,
           CASE WHEN volatility_20d IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY round(volatility_20d, 9) DESC NULLS LAST) END AS volatility_rank
    FROM f""")
def liquidity_ranks(spark, sf_dir):
    f = t.daily_features(v.bars(spark, sf_dir, by_ticker=True))
    # What isn't ranked isn't written, nor worked out.
    f = f.select("ticker", "date", F.round("avg_turnover_20d", 4).alias("a"), F.round("avg_volume_20d", 4).alias("b"), F.round("volatility_20d", 9).alias("c"))
    return t.date_ranks(f, {"turnover_rank": "a", "volume_rank": "b", "volatility_rank": "c"}).select("ticker", "date", "turnover_rank", "volume_rank", "volatility_rank")


@query(f"""WITH {v.BARS},
    d AS (SELECT date, count(*) AS tickers FROM bars GROUP BY 1)
    SELECT CAST((SELECT count(*) FROM bars) AS BIGINT) AS n_rows,
           CAST((SELECT count(*) FROM bars) - (SELECT count(*) FROM (SELECT DISTINCT ticker, date FROM bars)) AS BIGINT) AS duplicate_keys,
           count(*) AS n_dates, min(tickers) AS min_tickers, max(tickers) AS max_tickers,
           {", ".join(f"(SELECT count(*) FROM bars WHERE {c} <= 0) AS nonpositive_{c}" for c in ("open", "high", "low", "close"))},
           (SELECT count(*) FROM bars WHERE volume = 0) AS zero_volume, (SELECT count(*) FROM bars WHERE turnover_value = 0) AS zero_turnover,
           (SELECT count(*) FROM bars WHERE abs(adjustment_factor - 1) > 1e-12) AS adjusted_rows, 'ok' AS status
    FROM d""")
def bar_quality_report(spark, sf_dir):
    return q.bar_quality(v.bars(spark, sf_dir))


COVERED = ("open", "close", "volume", "prev_close")


@query(f"""WITH {v.BARS}, x AS (SELECT *, lag(close) OVER {W} AS prev_close FROM bars)
    {" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n_known, count(*) - count({c}) AS n_missing, round(count({c}) / count(*), 6) AS ratio FROM x" for c in COVERED)}""")
def field_coverage(spark, sf_dir):
    b = v.bars(spark, sf_dir).withColumn("prev_close", F.lag("close").over(t.by_date()))
    return q.field_coverage(b, list(COVERED)).withColumn("ratio", r6("ratio"))


def _universe(spark, sf_dir):
    """All suppliers and two codes that never trade."""
    return v.table(spark, sf_dir, "supplier").select(v.ticker("s_suppkey").alias("ticker")).unionByName(spark.createDataFrame([("9X01",), ("9X02",)], "ticker string"))


UNIVERSE = "universe AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS ticker FROM supplier UNION ALL SELECT '9X01' UNION ALL SELECT '9X02')"


@query(f"""WITH {v.BARS}, {UNIVERSE},
    p AS (SELECT ticker, count(*) AS n, min(date) AS a, max(date) AS b FROM bars GROUP BY 1),
    j AS (SELECT u.ticker AS u, p.ticker AS p, coalesce(n, 0) AS n, a, b FROM universe u FULL OUTER JOIN p ON u.ticker = p.ticker)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(p) AS n_tickers, min(a) AS first_date, max(b) AS last_date, 0 AS duplicate_keys, min(n) AS min_rows, max(n) AS max_rows,
           {", ".join(f"CAST(count(*) FILTER (n < {k}) AS BIGINT) AS below_{k}" for k in (6, 21, 61))}, CAST(count(*) FILTER (u IS NOT NULL AND p IS NULL) AS BIGINT) AS missing_tickers
    FROM j""")
def store_verification(spark, sf_dir):
    return q.store_check(v.bars(spark, sf_dir), _universe(spark, sf_dir))


@query(f"""WITH {v.BARS},
    d AS (SELECT DISTINCT date FROM bars), h AS (SELECT unnest([5, 20, 60]) AS horizon),
    c AS (SELECT d.date, b.ticker, count(*) FILTER (b.date > d.date) AS n FROM d CROSS JOIN bars b WHERE d.date >= DATE '1998-06-01' GROUP BY 1, 2),
    m AS (SELECT date, min(n) AS n FROM c GROUP BY 1)
    SELECT CAST(horizon AS INTEGER) AS horizon, max(date) FILTER (n >= horizon + 1) AS latest_date FROM m, h GROUP BY 1""")
def latest_eligible_date(spark, sf_dir):
    b = v.bars(spark, sf_dir)
    return q.latest_eligible_dates(b, b)


@query(f"""WITH {v.BARS}, {UNIVERSE}, d AS (SELECT DISTINCT date FROM bars)
    SELECT d.date, count(*) FILTER (b.ticker IS NULL) AS n_missing FROM d CROSS JOIN universe u LEFT JOIN bars b ON b.date = d.date AND b.ticker = u.ticker GROUP BY 1""")
def missing_by_date(spark, sf_dir):
    b = v.bars(spark, sf_dir)
    return q.missing_by_date(b, _universe(spark, sf_dir), b)


@query(f"""WITH {v.BARS}, u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS ticker FROM supplier)
    SELECT date FROM bars JOIN u USING (ticker) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM u)""")
def complete_dates(spark, sf_dir):
    """Dates on which every supplier has a bar."""
    return q.complete_dates(v.bars(spark, sf_dir), v.table(spark, sf_dir, "supplier").select(v.ticker("s_suppkey").alias("ticker")))


@query(f"""WITH {v.BARS}, alt AS (
        SELECT lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, avg(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS close
        FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS n_compared, round(max(abs(b.close - a.close)), 6) AS max_abs_diff, count(*) FILTER (abs(b.close - a.close) > 0.01) AS n_mismatch
    FROM bars b JOIN alt a ON a.ticker = b.ticker AND a.date = b.date""")
def adj_close_consistency(spark, sf_dir):
    line = v.table(spark, sf_dir, "lineitem")
    alt = line.groupBy(v.ticker("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("close"))
    return q.consistency(v.bars(spark, sf_dir), alt, "close", 0.01).withColumn("max_abs_diff", r6("max_abs_diff"))


@query(f"""WITH {v.BARS}, alt AS (
        SELECT lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, avg(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS close
        FROM lineitem GROUP BY 1, 2)
    SELECT b.ticker, b.date, round(b.close, 6) AS a, round(a.close, 6) AS b, round(abs(b.close - a.close), 6) AS diff
    FROM bars b JOIN alt a ON a.ticker = b.ticker AND a.date = b.date WHERE abs(b.close - a.close) > 0.01 ORDER BY b.ticker, b.date LIMIT 100""")
def adj_close_mismatches(spark, sf_dir):
    """The first hundred differences that adj_close_consistency counts."""
    line = v.table(spark, sf_dir, "lineitem")
    alt = line.groupBy(v.ticker("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("close"))
    return q.mismatches(v.bars(spark, sf_dir), alt, "close", 0.01, first=100).withColumns({c: r6(c) for c in ("a", "b", "diff")})


ORDER = ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ORDER)
    return f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_extendedprice, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS k FROM lineitem) WHERE k = 1"""




@query(_dedup_sql("DESC"))
def dedup_last_wins(spark, sf_dir):
    return q.dedup(v.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], list(ORDER)).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_extendedprice", "l_suppkey")


@query(_dedup_sql("ASC"))
def dedup_first_wins(spark, sf_dir):
    return q.dedup(v.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], list(ORDER), False).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_extendedprice", "l_suppkey")


FORWARD = f"""
fw0 AS (
    SELECT ticker, date, close AS base_price, lag(date) OVER {W} AS before, {", ".join(f"lead(close, {h}) OVER {W} AS later_{h}" for h in v.HORIZONS)} FROM bars),
fw AS (
    SELECT decision_date, ticker, date AS base_date, base_price, {", ".join(f"(later_{h} / base_price - 1) * 100 AS forward_return_h{h}, CASE WHEN later_{h} IS NULL THEN 'not_enough_rows' ELSE 'ok' END AS status_h{h}" for h in v.HORIZONS)}
    FROM fw0 JOIN dates ON date > decision_date AND (before IS NULL OR before <= decision_date))"""


@query(f"""WITH {v.BARS}, {v.DATES_SQL}, {FORWARD}
    SELECT decision_date, ticker, base_date, round(base_price, 6) AS base_price, {", ".join(f"round(forward_return_h{h}, 6) AS forward_return_h{h}, status_h{h}" for h in v.HORIZONS)} FROM fw""")
def forward_returns(spark, sf_dir):
    f = t.forward_returns(v.bars(spark, sf_dir), v.decision_dates(spark))
    return f.withColumns({c: r6(c) for c in ["base_price", *[f"forward_return_h{h}" for h in v.HORIZONS]]})


@query(f"""WITH {v.BARS}, {v.STATEMENTS}, l AS (SELECT DISTINCT ticker, disclosure_date AS dd FROM statements),
    n AS (SELECT l.ticker, dd, count(*) FILTER (b.date > dd) AS n FROM l LEFT JOIN bars b USING (ticker) GROUP BY 1, 2), h AS (SELECT unnest([5, 20, 60]) AS horizon)
    SELECT ticker, CAST(horizon AS INTEGER) AS horizon, dd AS disclosure_date, n AS n_after, n >= horizon + 1 AS eligible,
           CASE WHEN n = 0 THEN 'no_rows_after_disclosure' WHEN n < horizon + 1 THEN 'not_enough_rows' ELSE '' END AS reason FROM n, h""")
def readiness(spark, sf_dir):
    """Readiness by each of all statements; no bar follows the latest ones of the given tables."""
    return t.readiness(v.bars(spark, sf_dir), v.statements(spark, sf_dir), every=True)


@query(f"""WITH {v.BARS}, {v.COMPANIES}, {v.DATES_SQL}, {FORWARD},
    x AS (SELECT fw.*, coalesce(sector, 'none') AS sector, CASE WHEN base_price >= 1500 THEN 'high' ELSE 'low' END AS price_band FROM fw LEFT JOIN companies USING (ticker)),
    l AS (SELECT sector, price_band, CAST(decision_date AS VARCHAR) AS decision, unnest([5, 20, 60]) AS horizon, unnest([forward_return_h5, forward_return_h20, forward_return_h60]) AS ret FROM x),
    g AS (SELECT 'sector' AS dimension, sector AS value, horizon, ret FROM l UNION ALL SELECT 'price_band', price_band, horizon, ret FROM l UNION ALL SELECT 'decision', decision, horizon, ret FROM l)
    SELECT dimension, value, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, count(ret) AS n_available, count(*) - count(ret) AS n_missing, round(avg(ret), 6) AS mean_ret, round(median(ret), 6) AS median_ret,
           round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 6) AS hit_rate, round(min(ret), 6) AS min_ret, round(max(ret), 6) AS max_ret
    FROM g GROUP BY 1, 2, 3""")
def grouped_summary(spark, sf_dir):
    f = t.forward_returns(v.bars(spark, sf_dir), v.decision_dates(spark)).join(v.companies(spark, sf_dir).select("ticker", "sector"), "ticker", "left")
    f = f.select(F.coalesce("sector", F.lit("none")).alias("sector"), F.when(F.col("base_price") >= 1500, "high").otherwise("low").alias("price_band"), F.col("decision_date").cast("string").alias("decision"), *[f"forward_return_h{h}" for h in v.HORIZONS])
    return t.grouped_summary(f, ["sector", "price_band", "decision"]).withColumns({c: r6(c) for c in ("mean_ret", "median_ret", "hit_rate", "min_ret", "max_ret")})
