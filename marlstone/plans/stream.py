"""The streaming query: daily bars of the events table, upserted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, scratch, views as v
from ..streaming import upsert
from . import series
from .base import query


@query("""SELECT user_id, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS turnover, CAST(max(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS high,
    CAST(min(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS low, count(*) AS volume FROM events GROUP BY 1, 2""")
def event_daily_upsert(spark, sf_dir):
    place = scratch.scratch_dir(spark)
    scratch.kept(spark, place)
    # A file stream wants a folder; the table may be one file.
    v.table(spark, sf_dir, "events").select("user_id", "ts", "value").write.parquet(f"{place}/source")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{place}/source").schema)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        out = upsert.run_daily(spark, f"{place}/source", f"{place}/store", f"{place}/state", schema)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return out.select("user_id", "date", *[F.col(c).cast("double").alias(c) for c in ("turnover", "high", "low")], "volume")


@query(f"WITH {series.UNIVERSE}, l AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, s_name AS company_name, r_name AS sector, n_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 17 <> 16) SELECT ticker, company_name, sector, market, company_name IS NOT NULL AS matched FROM universe LEFT JOIN l ON ticker = code")
def listed_master_match(spark, sf_dir):
    return readers.listed_match(series._universe(spark, sf_dir), v.companies(spark, sf_dir))


@query(f"""WITH {v.BARS}, {series.UNIVERSE}, c AS (SELECT u.ticker, count(b.ticker) AS n FROM universe u LEFT JOIN bars b USING (ticker) GROUP BY 1)
    SELECT ticker, CASE WHEN n = 0 THEN 'no_prices' WHEN n < 530 THEN 'partial_window' ELSE 'full_window' END AS coverage_status, n >= 530 AS usable FROM c""")
def universe_filter(spark, sf_dir):
    from ..operators import quality as q

    n = v.bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"))
    c = series._universe(spark, sf_dir).join(n, "ticker", "left").select("ticker", F.when(F.col("n").isNull(), "no_prices").when(F.col("n") < 530, "partial_window").otherwise("full_window").alias("coverage_status"))
    return c.join(q.usable(c).select("ticker", F.lit(True).alias("usable")), "ticker", "left").select("ticker", "coverage_status", F.coalesce("usable", F.lit(False)).alias("usable"))


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, sha256(CAST(o_orderkey AS VARCHAR)) AS entry_hash FROM orders),
    p AS (SELECT line, entry_hash, CASE WHEN line % 40 = 0 THEN 'broken' ELSE coalesce(lag(entry_hash) OVER (ORDER BY line), '') END AS parent_hash FROM c)
    SELECT line, parent_hash = coalesce(lag(entry_hash) OVER (ORDER BY line), '') AS linked FROM p""")
def ledger_chain_check(spark, sf_dir):
    """The chain over all orders, in ranges of their keys."""
    return _chain(v.table(spark, sf_dir, "orders"))


def _chain(orders):
    """line, linked of a ledger with an entry per order, of which every 40th names a wrong parent."""
    from ..operators import governance as g

    c = g.chained(orders.select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("entry_hash")), "o_orderkey", "entry_hash")
    c = c.select(F.col("place").alias("line"), "entry_hash", F.when(F.col("place") % 40 == 0, "broken").otherwise(F.coalesce("before", F.lit(""))).alias("parent_hash"))
    return g.chain_links(c).select("line", "linked")


@query("""WITH e AS (SELECT o_orderkey AS line, '{"body":{"customer":' || CAST(o_custkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"},"note":"","parent_hash":""}' AS content FROM orders)
    SELECT line, sha256(content) AS own_hash, line % 50 <> 0 AS sound FROM e""")
def ledger_hash_check(spark, sf_dir):
    """An entry for each order, its keys in another order than the canonical one; every 50th was changed after it was hashed."""
    from ..operators import governance as g

    o = v.table(spark, sf_dir, "orders")
    body = F.format_string('{"customer":%d,"status":"%s"}', F.col("o_custkey"), F.col("o_orderstatus"))
    content = F.concat(F.lit('{"body":'), body, F.lit(',"note":"","parent_hash":""}'))
    given = F.when(F.col("o_orderkey") % 50 == 0, F.lit("0")).otherwise(F.sha2(content, 256))
    line = F.concat(F.lit('{ "parent_hash": "", "entry_hash": "'), given, F.lit('", "note": "", "body": {"status": "'), F.col("o_orderstatus"), F.lit('", "customer": '), F.col("o_custkey").cast("string"), F.lit("}}"))
    return g.entry_hashes(o.select(F.col("o_orderkey").alias("line"), line.alias("value"))).select("line", "own_hash", "sound")
