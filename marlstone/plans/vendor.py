"""Dated vendor rows: from a cache by the data source, as VARIANT rows, and by a resumable backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import canonical_json, to_number, variant_field, variant_text
from ..sources import dated, readers
from ..sources import views as v
from ..streaming import backfill
from .base import query
from .exchange import _place, _places
from .series import UNIVERSE, _universe


def _cached(rows: DataFrame, path: str, *order) -> None:
    """Rows (date, value, an object's text) as the source's cache: a folder for each date, an object a line, in order."""
    # The writer keeps the order of rows that are sorted by its folders already.
    rows.repartition("date").sortWithinPartitions("date", *order).select("date", "value").write.partitionBy("date").text(path)


def _span(rows: DataFrame) -> dict[str, str]:
    one = rows.agg(F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).first()
    return one.asDict()


@query(f"""WITH {v.BARS} SELECT ticker, date, round(open, 10) AS open, round(close, 10) AS close, volume, '1' AS upper_limit_flag,
    'T' || ticker AS nested FROM bars""")
def dated_source_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar, as vendor rows of its date in a cache, through the data source and as VARIANT rows."""
    b, path = v.bars(spark, sf_dir), _place(spark)
    fields = F.struct(F.concat("ticker", F.lit("0")).alias("Code"), F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("open").alias("O"), F.col("close").cast("string").alias("C"), F.col("volume").alias("Vo"), F.lit(True).alias("UL"), F.struct(F.concat(F.lit("T"), "ticker").alias("name")).alias("more"))
    _cached(b.select("date", F.to_json(fields).alias("value")), path)
    dated.register(spark)
    rows = spark.read.format(dated.NAME).options(cache=path, closed="true", dates_per_task="64", **_span(b)).load()
    fields = readers.vendor_rows(rows, "row")
    both = fields.select("fields", variant_field("fields", "more.name").alias("nested"))
    bars = readers.vendor_bars(both.select("fields")).select("ticker", "date", "open", "close", "volume", "upper_limit_flag", "source_fields_json")
    out = bars.withColumn("nested", variant_field(F.parse_json("source_fields_json"), "more.name")).drop("source_fields_json")
    return _places(out, "open", "close")


@query("""SELECT s_suppkey, '{"Code":"' || CAST(s_suppkey AS VARCHAR) || '","a":{"x":null,"y":[1,2],"z":"' || s_name || '"},"n":' || CAST(s_suppkey AS VARCHAR) || '}' AS canonical, s_name AS name, CAST(s_suppkey AS BIGINT) AS n FROM supplier""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of rows whose keys stand in another order, and two fields by their paths."""
    s = v.table(spark, sf_dir, "supplier")
    text = F.format_string('{ "n": %d, "a": {"z": "%s", "y": [1, 2], "x": null}, "Code": "%d"}', F.col("s_suppkey"), F.col("s_name"), F.col("s_suppkey"))
    s = s.select("s_suppkey", text.alias("t"))
    return s.select("s_suppkey", canonical_json("t").alias("canonical"), variant_field(F.parse_json("t"), "a.z").alias("name"), variant_field(F.parse_json("t"), "n", "bigint").alias("n"))


DISCLOSED = "disclosure_date + CAST(CAST(ticker AS BIGINT) % 28 AS INTEGER)"


@query(f"""WITH {v.STATEMENTS}, {UNIVERSE}, s AS (SELECT DISTINCT ticker, fiscal_year, {DISCLOSED} AS disclosed, round(revenue, 4) AS revenue FROM statements)
    SELECT ticker, CAST(disclosed AS DATE) AS disclosed, CAST(disclosed AS DATE) AS query_date, fiscal_year, revenue, TRUE AS first FROM s WHERE ticker IN (SELECT ticker FROM universe)""")
def summary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements through the backfill, in two runs: dates that the first one can't get are carried over to the second."""
    st, path = v.statements(spark, sf_dir), _place(spark)
    st = st.select("ticker", "fiscal_year", F.date_add("disclosure_date", (F.col("ticker").cast("long") % 28).cast("int")).alias("date"), "revenue")
    code = F.concat("ticker", F.lit("0"))
    row = lambda first: F.to_json(F.struct(code.alias("Code"), F.date_format("date", "yyyy-MM-dd").alias("DiscDate"), F.concat_ws("-", "fiscal_year", code).alias("DiscNo"), F.col("revenue").cast("string").alias("Sales"), F.col("fiscal_year").alias("year"), F.lit(first).alias("first")))
    # Each row is there twice, the second time with another content; in a file the first one counts.
    both = st.select("date", F.posexplode(F.array(row(True), row(False))).alias("nth", "value"))
    span = _span(st)
    _cached(both, f"{path}/all", "nth")
    _cached(both.where(F.dayofmonth("date") % 2 == 0), f"{path}/half", "nth")
    universe = _universe(spark, sf_dir)
    every = {"cap": 10**6, "dates_per_task": 64}
    backfill.run(spark, f"{path}/store", universe, cache=f"{path}/half", **span, **every)
    rows = backfill.run(spark, f"{path}/store", universe, cache=f"{path}/all", closed=True, **span, **every)
    out = rows.select("ticker", "disclosed", "query_date", variant_field("fields", "year", "int").alias("fiscal_year"), to_number(variant_text("fields", "Sales")).alias("revenue"), variant_field("fields", "first", "boolean").alias("first"))
    return out.withColumn("revenue", F.round("revenue", 4))

