"""Readers and writers over whole tables: what goes out in a format must come back as it was.

Each query writes a view in the form that a source has (headers, text dates,
vendor field names), reads it with that source's reader and returns the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as s
from ..operators import modeling as m
from ..operators import quality as q
from ..sources import ingest, readers, scratch, sinks
from ..sources import views as v
from .base import query
from .models import FULL, LABEL, scored
from .series import UNIVERSE, _universe

OHLC = ("open", "high", "low", "close")
#: Prices are quotients whose halves at fewer places the two engines round apart.
PLACES = 10


def _place(spark) -> str:
    """A new folder for a format's files, deleted at the process's end."""
    path = scratch.scratch_dir(spark)
    scratch.kept(spark, path)
    return path


def _rounded(*names: str) -> str:
    return ", ".join(f"round({c}, {PLACES}) AS {c}" for c in names)


def _places(df, *names: str):
    return df.withColumns({c: F.round(c, PLACES) for c in names})


@query(f"WITH {v.BARS} SELECT ticker, date, {_rounded(*OHLC, 'adj_close')}, volume FROM bars")
def prices_csv_source(spark, sf_dir):
    """Bars through a CSV with Japanese headers, a byte-order mark's case apart, text dates and thousands separators."""
    b, path = v.bars(spark, sf_dir), _place(spark)
    out = b.select(F.col("ticker").alias("銘柄コード"), F.date_format("date", "yyyy/MM/dd").alias(" 日付 "), F.col("open").alias("始値"), F.col("high").alias("高値"), F.col("low").alias("安値"), F.col("close").alias("終値"), F.col("adj_close").alias("調整後終値"), F.format_number("volume", 2).alias("出来高"))
    out.write.option("header", True).csv(path)
    return _places(readers.read(spark, "prices", path), *OHLC, "adj_close").select("ticker", "date", *OHLC, "adj_close", "volume")


STATED = ("revenue", "operating_income", "net_income", "eps", "bps", "dividends_per_share", "shares_outstanding", "total_assets", "equity", "operating_cash_flow", "capital_expenditure")


@query(f"WITH {v.STATEMENTS} SELECT ticker, fiscal_year, fiscal_period, accounting_basis, {', '.join(f'round({c}, 4) AS {c}' for c in STATED)} FROM statements")
def statements_csv_source(spark, sf_dir):
    """Statements through a CSV with other names for most columns."""
    path = _place(spark)
    names = {"ticker": "Code", "fiscal_year": "FY", "fiscal_period": "Period", "accounting_basis": "basis", "revenue": "売上高", "operating_income": "営業利益", "net_income": "当期純利益", "dividends_per_share": "dps", "shares_outstanding": "shares", "total_assets": "総資産", "equity": "自己資本", "operating_cash_flow": "ocf", "capital_expenditure": "capex", "eps": "EPS", "bps": " bps"}
    v.statements(spark, sf_dir).select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).csv(path)
    return readers.read(spark, "statements", path).withColumns({c: F.round(c, 4) for c in STATED})


@query(f"WITH {v.COMPANIES} SELECT ticker, company_name || ' (new)' AS company_name, sector, market FROM companies")
def companies_csv_source(spark, sf_dir):
    """Metadata of which each ticker stands twice in the file; the later line counts."""
    c, path = v.companies(spark, sf_dir), _place(spark)
    both = c.select("ticker", F.lit("old").alias("社名"), "sector", "market", F.lit(0).alias("k")).unionByName(c.select("ticker", F.concat("company_name", F.lit(" (new)")).alias("社名"), "sector", "market", F.lit(1).alias("k")))
    both.orderBy("k", "ticker").drop("k").coalesce(1).write.option("header", True).csv(path)  # one file, as such a file's order counts
    return readers.read(spark, "companies", path)


@query(f"WITH {v.BARS} SELECT ticker, date, {_rounded(*OHLC, 'adj_close')}, volume, round(turnover_value, 4) AS turnover_value, round(adjustment_factor, 8) AS adjustment_factor FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def quotes_json_source(spark, sf_dir):
    """Vendor quotes, half with short and half with long field names, asked for three years."""
    b, path = v.bars(spark, sf_dir), _place(spark)
    short = {"O": "open", "H": "high", "L": "low", "C": "close", "Vo": "volume", "Va": "turnover_value", "AdjFactor": "adjustment_factor", "AdjC": "adj_close"}
    long = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "TurnoverValue": "turnover_value", "AdjustmentFactor": "adjustment_factor", "AdjustmentClose": "adj_close"}
    odd = F.col("ticker") % 2 == 1
    vendor = b.select(F.concat("ticker", F.lit("0")).alias("Code"), F.date_format("date", "yyyyMMdd").alias("Date"), *[F.when(odd, F.col(c)).alias(n) for n, c in short.items()], *[F.when(~odd, F.col(c)).alias(n) for n, c in long.items()])
    vendor.write.json(path)
    d = readers.quotes_json(spark, path, "1995-01-01", "1997-12-31", lines=True)
    return _places(d, *OHLC, "adj_close").withColumns({"turnover_value": F.round("turnover_value", 4), "adjustment_factor": F.round("adjustment_factor", 8)}).select("ticker", "date", *OHLC, "adj_close", "volume", "turnover_value", "adjustment_factor")


@query(f"WITH {v.STATEMENTS} SELECT ticker, fiscal_year, fiscal_period, disclosure_date, {', '.join(f'round({c}, 4) AS {c}' for c in ('revenue', 'operating_income', 'net_income', 'eps', 'bps', 'total_assets', 'equity'))} FROM statements")
def statements_json_source(spark, sf_dir):
    """Vendor statements as text numbers; the fiscal year is that of its end, or of the period's end where that is missing."""
    st, path = v.statements(spark, sf_dir), _place(spark)
    end = F.concat(F.col("fiscal_year").cast("string"), F.lit("-12-31"))
    odd = F.col("ticker") % 2 == 1
    text = {"Sales": "revenue", "OP": "operating_income", "NP": "net_income", "EPS": "eps", "BPS": "bps", "TA": "total_assets", "Eq": "equity"}
    st.select(F.concat("ticker", F.lit("0")).alias("Code"), F.when(odd, end).alias("CurFYEn"), end.alias("CurPerEn"), F.col("fiscal_period").alias("CurPerType"), F.date_format("disclosure_date", "yyyy-MM-dd").alias("DiscDate"), *[F.col(c).cast("string").alias(n) for n, c in text.items()]).write.json(path)
    d = readers.statements_json(spark, path, lines=True)
    names = list(text.values())
    return d.withColumns({c: F.round(c, 4) for c in names}).select("ticker", "fiscal_year", "fiscal_period", "disclosure_date", *names)


@query(f"WITH {v.COMPANIES} SELECT ticker, company_name, sector, market FROM companies")
def listed_json_source(spark, sf_dir):
    """The listed master's snapshot."""
    path = _place(spark)
    v.companies(spark, sf_dir).select(F.concat("ticker", F.lit("0")).alias("Code"), F.col("company_name").alias("CoName"), F.col("sector").alias("S33Nm"), F.col("market").alias("MktNm")).write.json(path)
    return readers.listed_json(spark, path, lines=True)


RAW_JSON = f"""WITH {v.BARS}, k AS (SELECT *, CAST(ticker AS BIGINT) % 4 AS r FROM bars)
    SELECT ticker, date, round(open, 10) AS open, round(close, 10) AS close, volume, CASE r WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE '2' END AS upper_limit_flag,
           CASE r WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '' ELSE 'x' END AS lower_limit_flag, TRUE AS clean FROM k"""


@query(RAW_JSON)
def vendor_bar_rows(spark, sf_dir):
    """Raw vendor rows as the canonical columns: flags in one form, no secret in the copy of the source's fields."""
    b = v.bars(spark, sf_dir).withColumn("r", F.col("ticker").cast("long") % 4)
    pick = lambda *x: F.when(F.col("r") == 0, x[0]).when(F.col("r") == 1, x[1]).when(F.col("r") == 2, x[2]).otherwise(x[3])
    fields = {"Code": F.concat("ticker", F.lit("0")), "Date": F.date_format("date", "yyyy/MM/dd"), "O": F.lit(""), "Open": F.col("open").cast("string"), "C": F.col("close").cast("string"), "Vo": F.format_number("volume", 1), "UL": pick("True", "no", "", "2"), "LL": pick("f", "YES", "", "x"), "api_key": F.lit("hidden")}
    raw = b.select(F.to_json(F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values()))).alias("value"))
    d = readers.vendor_bars(readers.vendor_rows(raw))
    clean = ~F.lower("source_fields_json").contains("hidden") & F.col("source_fields_json").contains("Code")
    return _places(d, "open", "close").select("ticker", "date", "open", "close", "volume", "upper_limit_flag", "lower_limit_flag", clean.alias("clean"))


@query(f"WITH {v.DISCLOSURES} SELECT ticker, CAST(doc_id AS VARCHAR) AS doc_id, length(coalesce(text, '')) AS n_chars, 1 AS n_warnings FROM disclosures WHERE doc_id IS NOT NULL")
def export_dir_source(spark, sf_dir):
    """An export folder with an index and two documents of each ticker, of which the later counts."""
    d, path = v.disclosures(spark, sf_dir).where("doc_id IS NOT NULL"), _place(spark)
    doc = lambda day, text: d.select(F.concat("ticker", F.lit("0")).alias("sec_code"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(day).alias("target_date"), text.alias("text"))
    both = doc("2024-05-01", F.lit("older")).unionByName(doc("2024-05-02", F.col("text")))
    both.write.json(f"{path}/documents")
    d.select(F.col("doc_id").cast("string").alias("doc_id")).write.json(f"{path}/index.json")
    got = readers.export_dir(spark, path, lines=True)
    return got.select("ticker", "doc_id", F.length("text").alias("n_chars"), F.size("warnings").alias("n_warnings"))


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS ticker, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def universe_file_source(spark, sf_dir):
    """A list of codes with comments and repetitions; its order is the first mention's."""
    path = _place(spark)
    k = v.table(spark, sf_dir, "supplier").select("s_suppkey")
    first = k.select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit("  # listed")).alias("line"), F.lit(0).alias("k"))
    again = k.select("s_suppkey", F.concat(v.ticker("s_suppkey"), F.when(F.col("s_suppkey") < 10000, F.lit("0")).otherwise("")).alias("line"), F.lit(1).alias("k"))
    first.unionByName(again).orderBy("k", "s_suppkey").select("line").coalesce(1).write.text(f"{path}/universe.txt")
    got = readers.universe_file(spark, f"{path}/universe.txt")
    return s.ranked_overall(got, "seq", "place").select("ticker", F.col("place").cast("long").alias("place"))


@query(f"WITH {v.BARS} SELECT ticker, date, round(close + 1, 10) AS close, volume FROM bars")
def bar_store_upsert(spark, sf_dir):
    """A store written twice over: of rows that repeat a key the later ones count."""
    b, path = v.bars(spark, sf_dir), _place(spark)
    sinks.bar_store(b.withColumn("seq", F.lit(1)).unionByName(b.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2))), path)
    return _places(spark.read.parquet(path), "close").select("ticker", "date", "close", "volume")


@query(f"WITH {v.BARS} SELECT ticker, date, round(adj_close, 10) AS close, row_number() OVER (ORDER BY ticker, date) AS line FROM bars")
def price_export_file(spark, sf_dir):
    """The export of adjusted prices, in files of some thousand rows, read again in its order."""
    path = _place(spark)
    sinks.price_export(v.bars(spark, sf_dir), path, "adj_close", rows=20_000)
    return _places(readers.ordered_rows(spark, path, "ticker string, date date, close double"), "close").select("ticker", "date", "close", "line")


@query(f"WITH {v.BARS}, {UNIVERSE}, c AS (SELECT u.ticker, count(b.ticker) AS n FROM universe u LEFT JOIN bars b USING (ticker) GROUP BY 1) SELECT ticker, CASE WHEN n = 0 THEN 'no_prices' WHEN n < 530 THEN 'partial_window' ELSE 'full_window' END AS coverage_status, CAST(n AS VARCHAR) AS reason FROM c")
def coverage_csv_source(spark, sf_dir):
    """The universe's coverage through its CSV."""
    path = _place(spark)
    n = v.bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"))
    c = _universe(spark, sf_dir).join(n, "ticker", "left").fillna(0, ["n"])
    status = F.when(F.col("n") == 0, "no_prices").when(F.col("n") < 530, "partial_window").otherwise("full_window")
    c.select(F.col("ticker").alias("Ticker"), status.alias("coverage_status"), F.col("n").cast("string").alias("reason")).write.option("header", True).csv(path)
    return readers.read(spark, "coverage", path)


@query(f"WITH {v.BARS}, {UNIVERSE}, c AS (SELECT u.ticker, count(b.ticker) AS n FROM universe u LEFT JOIN bars b USING (ticker) GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'no_prices' WHEN n < 530 THEN 'partial_window' ELSE 'full_window' END AS coverage_status, count(*) AS n FROM c GROUP BY 1")
def coverage_counts(spark, sf_dir):
    """How many names have each status."""
    return q.status_counts(coverage_csv_source(spark, sf_dir), "coverage_status")


@query(f"""WITH {v.BARS}, mo AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, sum(turnover_value) AS turnover, sum(volume) AS volume FROM bars GROUP BY 1)
    SELECT 'turnover' AS metric, date, round(turnover, 2) AS value FROM mo UNION ALL SELECT 'volume', date, round(volume, 2) FROM mo""")
def series_csv_source(spark, sf_dir):
    """Monthly metrics through their wide CSV."""
    path = _place(spark)
    b = v.bars(spark, sf_dir).groupBy(F.trunc("date", "month").alias("Date")).agg(F.sum("turnover_value").alias("turnover"), F.sum("volume").alias("volume"))
    b.write.option("header", True).csv(path)
    return readers.read(spark, "series", path).withColumn("value", F.round("value", 2))


@query(f"WITH {v.BARS} SELECT ticker, round(avg(turnover_value), 4) AS adv FROM bars GROUP BY 1")
def adv_csv_source(spark, sf_dir):
    """Average daily values through their CSV; added as decimals, so that no order of the bars tips a half of the fourth place."""
    path = _place(spark)
    mean = F.sum(F.col("turnover_value").cast("decimal(18,2)")) / F.count("turnover_value")
    v.bars(spark, sf_dir).groupBy(F.col("ticker").alias("Code")).agg(mean.cast("double").alias("ADV")).write.option("header", True).csv(path)
    return readers.read(spark, "adv", path).withColumn("adv", F.round("adv", 4))


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, sha256(CAST(o_orderkey AS VARCHAR)) AS entry_hash FROM orders)
    SELECT line, entry_hash, coalesce(lag(entry_hash) OVER (ORDER BY line), '') AS parent_hash FROM c""")
def ledger_source(spark, sf_dir):
    """A ledger of JSON lines with an entry per order, read in the order of its lines."""
    from ..operators import governance as g

    path = _place(spark)
    c = g.chained(v.table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("entry_hash")), "o_orderkey", "entry_hash")
    rows = c.select("place", F.to_json(F.struct("entry_hash", F.coalesce("before", F.lit("")).alias("parent_hash"), F.struct("o_orderkey").alias("body"))).alias("value"))
    rows.orderBy("place").select("value").write.text(path)
    return readers.read(spark, "ledger", path).select("line", "entry_hash", "parent_hash")


@query("""WITH x AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS c FROM supplier), y AS (
    SELECT k, c AS code FROM x UNION ALL SELECT k, lpad(c, 4, '0') || '0' FROM x UNION ALL SELECT k, ' ' || lower(lpad(c, 4, '0')) || '.t ' FROM x UNION ALL SELECT k, lpad(c, 3, '0') || 'A0' FROM x WHERE k < 1000)
    SELECT k, code, CASE WHEN regexp_full_match(trim(code, ' '), '[0-9]{4}0') THEN left(trim(code, ' '), 4) WHEN regexp_full_match(trim(code, ' '), '[0-9]{1,3}') THEN lpad(trim(code, ' '), 4, '0') ELSE trim(code, ' ') END AS padded,
           regexp_replace(upper(trim(code, ' ')), '\\.T$', '') AS suffixed, CASE WHEN regexp_full_match(trim(code, ' '), '[0-9]{4}0') THEN left(trim(code, ' '), 4) ELSE trim(code, ' ') END AS four,
           CASE WHEN regexp_full_match(trim(code, ' '), '[0-9]{4}0|[0-9]{3}[A-Z]0') THEN left(trim(code, ' '), 4) ELSE trim(code, ' ') END AS lettered FROM y""")
def code_forms(spark, sf_dir):
    """Codes in four spellings, brought to each of the four forms."""
    k = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("c"))
    codes = [F.col("c"), F.concat(F.lpad("c", 4, "0"), F.lit("0")), F.concat(F.lit(" "), F.lower(F.lpad("c", 4, "0")), F.lit(".t ")), F.when(F.col("k") < 1000, F.concat(F.lpad("c", 3, "0"), F.lit("A0")))]
    y = k.select("k", F.explode(F.array(*codes)).alias("code")).where("code IS NOT NULL")
    return y.select("k", "code", s.code_padded("code").alias("padded"), s.code_suffixed("code").alias("suffixed"), s.code_four("code").alias("four"), s.code_lettered("code").alias("lettered"))


@query("""WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DOUBLE) AS p FROM orders)
    SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE d END AS day, CASE WHEN k % 3 = 2 THEN NULL ELSE round(p, 2) END AS number FROM t""")
def lenient_casts(spark, sf_dir):
    """Dates in three forms and text numbers with separators; what is neither is NULL."""
    t = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("double").alias("p"))
    r = F.col("k") % 5
    day = F.when(r == 0, F.date_format("d", "yyyy-MM-dd")).when(r == 1, F.date_format("d", "yyyy/MM/dd")).when(r.isin(2, 3), F.date_format("d", " yyyyMMdd ")).otherwise("soon")
    number = F.when(F.col("k") % 3 == 0, F.format_number("p", 2)).when(F.col("k") % 3 == 1, F.col("p").cast("decimal(18,2)").cast("string")).otherwise("n/a")
    return t.select("k", s.to_day(day).alias("day"), F.round(s.to_number(number), 2).alias("number"))


@query(f"WITH {v.BARS}, b AS (SELECT *, date >= DATE '1998-01-01' AS late FROM bars), n AS (SELECT ticker, date, round(CASE WHEN late THEN close * 2 ELSE close END, 10) AS close FROM b) SELECT * FROM n")
def incremental_prices(spark, sf_dir):
    """A store brought up to date: dates from 1998 on are fetched again with other prices and replace what was stored."""
    b = v.bars(spark, sf_dir).select("ticker", "date", "close")
    universe = b.select("ticker").distinct()
    new = b.where("date >= '1998-01-01'").withColumn("close", F.col("close") * 2)
    after = ingest.merged(b, new, universe)
    return _places(after, "close").select("ticker", "date", "close")


@query(f"""{FULL} SELECT decision_date, count(score) AS n, round(avg(score), 8) AS mean, round(stddev_pop(score), 8) AS std, round(min(score), 8) AS min, round(median(score), 8) AS median, round(max(score), 8) AS max FROM sd GROUP BY 1""")
def factor_score_distribution(spark, sf_dir):
    """Per date the scores' spread: population deviation and median."""
    return m.score_distribution(scored(spark, sf_dir)).withColumns({c: F.round(c, 8) for c in ("mean", "std", "min", "median", "max")})


@query(f"""{FULL}
    SELECT 'score' AS name, round(avg(score), 8) AS mean FROM sd HAVING count(*) = count(score) UNION ALL SELECT '{LABEL}', round(avg({LABEL}), 8) FROM sd HAVING count(*) = count({LABEL}) UNION ALL SELECT 'n_groups', round(avg(n_groups), 8) FROM sd""")
def csv_numeric_means(spark, sf_dir):
    """Means of a report's columns of which every cell is a number."""
    path = _place(spark)
    scored(spark, sf_dir).select("sector", "score", LABEL, "n_groups").write.option("header", True).csv(path)
    return readers.numeric_means(spark, path).withColumn("mean", F.round("mean", 8))
