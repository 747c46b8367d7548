"""Canonical tables over the star schema, and the same as SQL.

The operators take any table of these forms; these views give them from
lineitem, orders, supplier, nation, region and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISION_DATES = ("1997-06-30", "1998-06-30", "1999-06-30", "2000-06-30")
HORIZONS = (5, 20, 60)
#: rule, category, keyword, severity, confidence, tone weight: an input table of the text rules.
LEXICON = (
    ("POS1", "positive", "thtion", "low", 60.0, 8.0),
    ("POS2", "positive", "attion", "low", 60.0, 6.0),
    ("NEG1", "negative", "ertion", "high", 70.0, -10.0),
    ("RISK1", "risk", "thanea", "critical", 65.0, -6.0),
    ("GRW1", "growth", "eauaux", "medium", 55.0, 5.0),
    ("UNC1", "uncertainty", "einheit", "medium", 50.0, -3.0),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(c):
    """A key as a code of at least four digits; lpad() would cut longer keys."""
    key = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.lpad(key, F.greatest(F.lit(4), F.length(key)), "0")


def bars(spark: SparkSession, sf_dir: str, by_ticker: bool = False) -> DataFrame:
    """Daily bars by ticker and date; money is added as decimals.

    ``by_ticker``: lines are moved once, by ticker, for bars and for windows
    by ticker alike; most lines are bars of their own, so that adding up
    before would save nothing.
    """
    line = table(spark, sf_dir, "lineitem").withColumn("ticker", ticker("l_suppkey"))
    line = line.repartition("ticker") if by_ticker else line
    ext, qty = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    unit = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    disc = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    raw = line.groupBy("ticker", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.median(unit).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum(ext).cast("double").alias("turnover_value"), F.sum(qty).cast("double").alias("volume"), F.sum(ext * disc).cast("double").alias("net")
    )
    close, adj = F.col("turnover_value") / F.col("volume"), F.col("net") / F.col("volume")
    factor = F.col("net") / F.col("turnover_value")
    return raw.select("ticker", "date", "open", "high", "low", close.alias("close"), "volume", "turnover_value", factor.alias("adjustment_factor"), *[(F.col(c) * factor).alias(f"adj_{c}") for c in ("open", "high", "low")], adj.alias("adj_close"))


BARS = """
raw AS (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
           median(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS open,
           max(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS high,
           min(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS low,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover_value,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))) AS DOUBLE) AS net
    FROM lineitem GROUP BY 1, 2),
bars AS (
    SELECT ticker, date, open, high, low, turnover_value / volume AS close, volume, turnover_value,
           net / turnover_value AS adjustment_factor, open * (net / turnover_value) AS adj_open,
           high * (net / turnover_value) AS adj_high, low * (net / turnover_value) AS adj_low, net / volume AS adj_close
    FROM raw)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years by ticker; disclosed at the end of the next January."""
    line, orders, supp = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    dec = lambda c, t="decimal(18,2)": F.col(c).cast(t)
    ext, disc, tax = dec("l_extendedprice"), F.lit(1).cast("decimal(4,2)") - dec("l_discount", "decimal(4,2)"), F.lit(1).cast("decimal(4,2)") + dec("l_tax", "decimal(4,2)")
    year = line.join(orders.select("o_orderkey", F.year("o_orderdate").alias("fiscal_year")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "fiscal_year").agg(
        F.sum(ext).cast("double").alias("revenue"), F.sum(ext * disc).cast("double").alias("net"), F.sum((ext * disc).cast("decimal(22,4)") * tax).cast("double").alias("charged")
    )
    s = year.join(supp.select("s_suppkey", F.col("s_acctbal").cast("double").alias("bal")), F.col("l_suppkey") == F.col("s_suppkey"))
    s = s.select(
        ticker("l_suppkey").alias("ticker"), F.col("fiscal_year").cast("int").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"),
        F.when(F.col("l_suppkey") % 11 == 10, "non_consolidated").otherwise("consolidated").alias("accounting_basis"),
        "revenue", (F.col("net") - 0.95 * F.col("revenue")).alias("net_income"), (F.col("charged") - 0.988 * F.col("revenue")).alias("operating_income"),
        (1000 + F.col("l_suppkey")).cast("double").alias("shares_outstanding"), (F.col("bal") * 1000).alias("equity"), (F.abs(F.col("bal") * 1000) * 2 + 1).alias("total_assets"),
    )
    eps = F.col("net_income") / F.col("shares_outstanding")
    return s.select(
        "*", eps.alias("eps"), (F.col("equity") / F.col("shares_outstanding")).alias("bps"), (F.greatest(eps, F.lit(0.0)) * 0.3).alias("dividends_per_share"),
        (F.col("net_income") + 0.02 * F.col("revenue")).alias("operating_cash_flow"), (0.03 * F.col("revenue")).alias("capital_expenditure"), F.make_date(F.col("fiscal_year") + 1, F.lit(1), F.lit(31)).alias("disclosure_date"),
    )


STATEMENTS = """
years AS (
    SELECT l_suppkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))) AS DOUBLE) AS net,
           CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS DECIMAL(22,4)) * CAST(1 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(4,2))) AS DOUBLE) AS charged
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
st AS (
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS ticker, fiscal_year, 'FY' AS fiscal_period,
           CASE WHEN l_suppkey % 11 = 10 THEN 'non_consolidated' ELSE 'consolidated' END AS accounting_basis,
           revenue, net - 0.95::DOUBLE * revenue AS net_income, charged - 0.988::DOUBLE * revenue AS operating_income,
           CAST(1000 + l_suppkey AS DOUBLE) AS shares_outstanding, CAST(s_acctbal AS DOUBLE) * 1000 AS equity,
           abs(CAST(s_acctbal AS DOUBLE) * 1000) * 2 + 1 AS total_assets
    FROM years JOIN supplier ON l_suppkey = s_suppkey),
statements AS (
    SELECT *, net_income / shares_outstanding AS eps, equity / shares_outstanding AS bps,
           greatest(net_income / shares_outstanding, 0) * 0.3::DOUBLE AS dividends_per_share,
           net_income + 0.02::DOUBLE * revenue AS operating_cash_flow, 0.03::DOUBLE * revenue AS capital_expenditure,
           make_date(fiscal_year + 1, 1, 31) AS disclosure_date
    FROM st)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sectors and markets; some suppliers have no metadata, so no sector."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # Nations and regions are tables of fixed size.
    place = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.where(F.col("s_suppkey") % 17 != 16).join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select(ticker("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"), F.col("r_name").alias("sector"), F.col("n_name").alias("market"))


COMPANIES = """
companies AS (
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS ticker, s_name AS company_name, r_name AS sector, n_name AS market
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 17 <> 16)"""


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest text of each ticker."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_supp"))
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n))  # one row
    docs = docs.select(ticker(F.col("doc_id") % F.col("n_supp") + 1).alias("ticker"), "doc_id", F.when(F.col("doc_id") % 50 == 49, "").otherwise(F.col("text")).alias("text"))
    return docs.groupBy("ticker").agg(F.max("doc_id").alias("doc_id"), F.max_by("text", "doc_id").alias("text"))


DISCLOSURES = """
dx AS (
    SELECT lpad(CAST(doc_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 4, '0') AS ticker, doc_id,
           CASE WHEN doc_id % 50 = 49 THEN '' ELSE text END AS text FROM documents),
disclosures AS (SELECT ticker, max(doc_id) AS doc_id, arg_max(text, doc_id) AS text FROM dx GROUP BY 1)"""


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "rule_id string, category string, keyword string, severity string, confidence double, tone_weight double")


LEXICON_SQL = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in LEXICON) + ") AS v(rule_id, category, keyword, severity, confidence, tone_weight))"


def decision_dates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DECISION_DATES], "d string").select(F.to_date("d").alias("decision_date"))


DATES_SQL = "dates AS (SELECT CAST(d AS DATE) AS decision_date FROM (VALUES " + ", ".join(f"('{d}')" for d in DECISION_DATES) + ") AS v(d))"
