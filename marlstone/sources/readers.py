"""Readers of prices, statements, metadata, texts, vendor JSON, stores and ledgers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import code_four, code_padded, code_suffixed, code_vendor, col, to_day, to_number, variant_text


class DataError(ValueError):
    """Input that can't be used."""


class SourceError(RuntimeError):
    """A source that doesn't answer or isn't there."""


#: The headers under which a column may stand in users' files.
PRICE = {
    "ticker": ("ticker", "code", "symbol", "銘柄コード"),
    "date": ("date", "trade_date", "日付"),
    "open": ("open", "始値"),
    "high": ("high", "高値"),
    "low": ("low", "安値"),
    "close": ("close", "close_price", "終値"),
    "volume": ("volume", "vol", "出来高"),
    "adj_close": ("adj_close", "adjusted_close", "adjclose", "adjustment_close", "調整後終値"),
}
STATEMENT = {
    "ticker": ("ticker", "code", "symbol"),
    "fiscal_year": ("fiscal_year", "year", "fy"),
    "fiscal_period": ("fiscal_period", "period"),
    "accounting_basis": ("accounting_basis", "basis"),
    "revenue": ("revenue", "sales", "net_sales", "売上高"),
    "operating_income": ("operating_income", "operating_profit", "営業利益"),
    "net_income": ("net_income", "net_profit", "profit", "当期純利益"),
    "eps": ("eps",),
    "bps": ("bps",),
    "dividends_per_share": ("dividends_per_share", "dps", "dividend"),
    "shares_outstanding": ("shares_outstanding", "shares"),
    "total_assets": ("total_assets", "総資産"),
    "equity": ("equity", "net_assets", "shareholders_equity", "自己資本"),
    "operating_cash_flow": ("operating_cash_flow", "ocf"),
    "capital_expenditure": ("capital_expenditure", "capex"),
}
COMPANY = {
    "ticker": ("ticker", "code", "symbol"),
    "company_name": ("company_name", "name", "company", "社名"),
    "sector": ("sector", "industry", "業種"),
    "market": ("market", "exchange", "市場"),
}
TEXT = {"ticker", "fiscal_period", "accounting_basis", "company_name", "sector", "market"}


def resolved(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by their own names, the first alias that is there; headers in any case, with spaces around or a byte-order mark."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.replace("﻿", "").strip().lower(), c)
    out: list[Column] = []
    for name, aliases in names.items():
        found = next((have[a] for a in aliases if a in have), None)
        out.append(F.col(f"`{found}`").alias(name) if found else F.lit(None).cast("string").alias(name))
    return df.select(*out)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def _json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Rows of JSON files, of an object a line if ``lines``, else of a list or object a file; all values as text."""
    return spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)


def _place() -> Column:
    """Where a row stands: file, part of the file, and row of the part; in that order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))


def _typed_columns(df: DataFrame, names) -> list[Column]:
    return [F.nullif(F.trim(c), F.lit("")).alias(c) if c in TEXT else to_day(c).alias(c) if c == "date" else to_number(c).cast("int").alias(c) if c == "fiscal_year" else to_number(c).alias(c) for c in names]


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*_typed_columns(df, df.columns))


def prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars; a row without ticker, date or close is an error."""
    df = _typed(resolved(_csv(spark, path), PRICE))
    wrong = F.col("ticker").isNull() | F.col("date").isNull() | F.col("close").isNull()
    if not df.where(wrong).isEmpty():
        at = _numbered(_typed_with(_csv(spark, path).withColumn("__at", _place()), PRICE)).where(wrong).orderBy("line").limit(3).collect()
        raise DataError(f"rows without ticker, date or close; the first are {[r['line'] for r in at]}")
    return df


def _typed_with(raw: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Resolved and typed columns, and __at as it is."""
    d = resolved(raw, names | {"__at": ("__at",)})
    return d.select(*_typed_columns(d, names), "__at")


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``line``, numbers from 1 in the files' order, from __at; what is ordered is a row for each part of a file."""
    parts = df.groupBy("__at.file", "__at.part").agg(F.count("*").alias("n"), F.min("__at.row").alias("__low"))
    w = Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("file").alias("__file"), F.col("part").alias("__part"), "__low", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    j = df.join(F.broadcast(parts), (F.col("__at.file") == F.col("__file")) & (F.col("__at.part") == F.col("__part")))
    return j.withColumn("line", F.col("__before") + F.col("__at.row") - F.col("__low") + 1).drop("__at", "__file", "__part", "__low", "__before")


def statements_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _typed(resolved(_csv(spark, path), STATEMENT))
    if not df.where("ticker IS NULL").isEmpty():
        raise DataError("statements without ticker")
    return df


def companies_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata; of rows that repeat a ticker the last one counts, by the files' names and then their lines."""
    df = resolved(_csv(spark, path).withColumn("__at", _place()), COMPANY | {"seq": ("__at",)})
    df = df.withColumn("k", F.row_number().over(Window.partitionBy(F.trim("ticker")).orderBy(F.desc("seq")))).where("k = 1 AND ticker IS NOT NULL")
    return _typed(df.select(*COMPANY))


def texts_dir(spark: SparkSession, path: str) -> DataFrame:
    """ticker, text of a folder's files <ticker>.txt."""
    df = spark.read.text(f"{path}/*.txt", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("ticker"), F.col("value").alias("text"))
    return df


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of several fields that is there and not empty."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def quotes_json(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, *, lines: bool = False) -> DataFrame:
    """Vendor quotes; short field names count before long ones; dates can be bounded after mapping."""
    df = _json(spark, path, lines)
    num = lambda *n: to_number(first_of(df, *n))
    out = df.select(code_four(first_of(df, "Code")).alias("ticker"), to_day(first_of(df, "Date")).alias("date"), num("O", "Open").alias("open"), num("H", "High").alias("high"), num("L", "Low").alias("low"), num("C", "Close").alias("close"), num("Vo", "Volume").alias("volume"), num("Va", "TurnoverValue").alias("turnover_value"), num("AdjFactor", "AdjustmentFactor").alias("adjustment_factor"), num("AdjC", "AdjustmentClose").alias("adj_close"))
    if first:
        out = out.where(F.col("date") >= F.to_date(F.lit(first)))
    return out.where(F.col("date") <= F.to_date(F.lit(last))) if last else out


def statements_json(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Vendor statements, whose numbers are text; the year is that of the fiscal year's end, else of the period's."""
    df = _json(spark, path, lines)
    num = lambda *n: to_number(first_of(df, *n))
    year = F.coalesce(F.year(to_day(first_of(df, "CurFYEn", "CurrentFiscalYearEndDate"))), F.year(to_day(first_of(df, "CurPerEn", "CurrentPeriodEndDate"))))
    return df.select(code_four(first_of(df, "Code", "LocalCode")).alias("ticker"), year.alias("fiscal_year"), first_of(df, "CurPerType", "TypeOfCurrentPeriod").alias("fiscal_period"), to_day(first_of(df, "DiscDate", "DisclosedDate")).alias("disclosure_date"), num("Sales", "NetSales").alias("revenue"), num("OP", "OperatingProfit").alias("operating_income"), num("NP", "Profit").alias("net_income"), num("EPS", "EarningsPerShare").alias("eps"), num("BPS", "BookValuePerShare").alias("bps"), num("TA", "TotalAssets").alias("total_assets"), num("Eq", "Equity").alias("equity"))


def listed_json(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    df = _json(spark, path, lines)
    return df.select(code_four(first_of(df, "Code")).alias("ticker"), first_of(df, "CoName", "CompanyName").alias("company_name"), first_of(df, "S33Nm", "Sector33CodeName").alias("sector"), first_of(df, "MktNm", "MarketCodeName").alias("market"))


#: Parts of field names whose values are secret.
SECRET_FIELD = "api_key|apikey|secret|token"


def without_secrets(fields: Column | str) -> Column:
    """A VARIANT object without fields whose names look like secrets, and without nulls."""
    parts = F.map_filter(col(fields).cast("map<string,variant>"), lambda k, x: x.isNotNull() & ~F.is_variant_null(x) & ~F.lower(k).rlike(SECRET_FIELD))
    return F.to_variant_object(parts)


def vendor_bars(raw: DataFrame) -> DataFrame:
    """Canonical columns of raw vendor rows, a VARIANT ``fields``: the first field that is there and not empty counts.

    A row without date or code is an error. source_fields_json is the row,
    its keys sorted, without fields whose names look like secrets.
    """
    first = lambda *names: variant_text("fields", *names)
    yes_no = lambda c: F.when(c.isNull(), "").when(F.lower(c).isin("true", "t", "yes"), "1").when(F.lower(c).isin("false", "f", "no"), "0").otherwise(c)
    code, day = first("Code", "LocalCode", "code", "ticker"), first("Date", "date")
    # The check is part of the plan: the rows are read once.
    sure = lambda c: F.when(code.isNull() | to_day(day).isNull(), F.raise_error(F.lit("vendor rows without date or code"))).otherwise(c)
    return raw.select(
        sure(code_vendor(code)).alias("ticker"), to_day(day).alias("date"),
        *[to_number(first(*names)).alias(c) for c, names in VENDOR_NUMBERS.items()],
        *[yes_no(first(*names)).alias(c) for c, names in VENDOR_FLAGS.items()],
        F.to_json(without_secrets("fields")).alias("source_fields_json"),
    )


#: A vendor's field names, the first that is there counts.
VENDOR_NUMBERS = {
    "adj_close": ("AdjC", "AdjClose", "AdjClosePrice", "AdjustmentClose"),
    "turnover_value": ("Va", "TurnoverValue"),
    "volume": ("Vo", "Volume"),
    "adj_open": ("AdjO", "AdjOpen", "AdjustmentOpen"),
    "adj_high": ("AdjH", "AdjHigh", "AdjustmentHigh"),
    "adj_low": ("AdjL", "AdjLow", "AdjustmentLow"),
    "adjustment_factor": ("AdjFactor", "AdjustmentFactor"),
    "open": ("O", "Open"),
    "high": ("H", "High"),
    "low": ("L", "Low"),
    "close": ("C", "Close"),
    "adj_volume": ("AdjVo", "AdjVolume", "AdjustmentVolume"),
}
VENDOR_FLAGS = {"upper_limit_flag": ("UL", "UpperLimitFlag"), "lower_limit_flag": ("LL", "LowerLimitFlag")}


def vendor_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """``fields``, a VARIANT for each row: ``column`` holds an object, or a list of them. Text that is neither is an error."""
    v = text.select(F.parse_json(column).alias("v"))
    one = F.array("v")
    rows = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), one)
    return v.where("v IS NOT NULL").select(F.explode(rows).alias("fields"))


def vendor_rows_json(spark: SparkSession, path: str, dates: list[str] | None = None, *, lines: bool = True) -> DataFrame:
    """Raw rows with all their fields as a VARIANT, from a folder of JSON files, one or more for each date; ``dates`` picks files by their names."""
    files = [f"{path}/*{d}*" for d in dates] if dates else [path]
    return vendor_rows(spark.read.text(files, wholetext=not lines))


def index_names(index: DataFrame) -> DataFrame:
    """doc_id of each entry of an index: a list, or an object with a list ``documents``, of paths or of objects with ``path`` or ``doc_id``.

    ``index`` has the text in ``value``: the whole list or object, or an entry
    a line. Paths count without their folders and ends. An entry that names
    nothing is an error.
    """
    v = index.where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    every = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.documents", "array<variant>"), F.array("v"))
    e = v.select(F.explode(every).alias("e"))
    alone = F.when(F.schema_of_variant("e") == "STRING", F.try_variant_get("e", "$", "string"))
    named = F.coalesce(alone, variant_text("e", "path"), variant_text("e", "doc_id"))
    name = F.regexp_replace(F.element_at(F.split(named, "/"), -1), r"\.json$", "")
    return e.select(F.coalesce(name, F.raise_error(F.lit("an index entry names no document"))).alias("doc_id")).distinct()


def export_dir(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Documents of an export folder; of several of a ticker the latest by date, then id.

    If there is an index.json, only documents that it names count: by id, by
    path, or by an object with either, in a list of its own or one that the
    index has as ``documents``.
    """
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{path}/documents") if _exists(spark, f"{path}/documents") else _json(spark, f"{path}/*/*.json", lines)
    df = df.select(code_four(first_of(df, "sec_code")).alias("ticker"), first_of(df, "doc_id").alias("doc_id"), to_day(first_of(df, "target_date")).alias("target_date"), first_of(df, "text").alias("text"))
    if _exists(spark, f"{path}/index.json"):
        index = spark.read.text(f"{path}/index.json", wholetext=not lines)
        names = index_names(index)
        df = df.join(names, "doc_id", "left_semi")
    w = Window.partitionBy("ticker")
    df = df.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc_nulls_last("target_date"), F.desc("doc_id"))))
    warning = F.when(F.col("n") > 1, F.array(F.lit("more than one document; the latest is used"))).otherwise(F.array().cast("array<string>"))
    return df.where("k = 1").select("ticker", "doc_id", "target_date", F.coalesce("text", F.lit("")).alias("text"), warning.alias("warnings"))


def bundle_date(spark: SparkSession, path: str):
    """The day of an export's index: its bundle date, else the latest document's; None if there is none."""
    if _exists(spark, f"{path}/index.json"):
        text = spark.read.text(f"{path}/index.json", wholetext=True).select(F.get_json_object("value", "$.disclosure_date").alias("a"), F.get_json_object("value", "$.target_date").alias("b"))
        day = text.select(F.coalesce(to_day("a"), to_day("b")).alias("d")).first()["d"]
        if day is not None:
            return day
    return export_dir(spark, path).agg(F.max("target_date")).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _text(spark: SparkSession, path: str) -> str:
    """A small file that Spark's readers pass by for its name."""
    if not _exists(spark, path):
        raise DataError(f"there is no {path}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes of a CSV with a code column, or of a list with # comments, in the file's order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "﻿", "").alias("line"))
    if path.endswith(".csv"):
        df = resolved(_csv(spark, path).withColumn("__seq", F.monotonically_increasing_id()), {"ticker": COMPANY["ticker"], "seq": ("__seq",)})
    else:
        df = lines.select(F.trim(F.regexp_replace("line", "#.*$", "")).alias("ticker"), "seq")
    df = df.where(F.length(F.trim("ticker")) > 0).select(code_padded("ticker").alias("ticker"), "seq")
    return df.groupBy("ticker").agg(F.min("seq").alias("seq")).orderBy("seq")


STORE = "ticker string, date date, open double, high double, low double, close double, volume double, turnover_value double, adjustment_factor double, adj_open double, adj_high double, adj_low double, adj_close double"


def bar_store(spark: SparkSession, path: str) -> DataFrame:
    """A bar store's CSV; its header must be just the store's."""
    want = [c.split()[0] for c in STORE.split(", ")]
    have = _csv(spark, path).columns
    if have != want:
        raise DataError(f"header {have}, not {want}")
    return spark.read.schema(STORE).option("header", True).option("enforceSchema", False).csv(path)


def ordered_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an ordered CSV with ``line``, their place in the order, from 1. Files that don't agree with the manifest are an error."""
    want = {f["file"]: f["rows"] for f in json.loads(_text(spark, f"{path}/_manifest.json"))["files"]}  # a line for each file
    df = spark.read.schema(schema).option("header", True).csv(path)
    have = {r["f"]: r["n"] for r in df.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
    if have != want:
        raise DataError(f"files differ from the manifest: {sorted(f for f in have.keys() | want.keys() if have.get(f) != want.get(f))[:3]}")
    return _numbered(df.withColumn("__at", _place()))


def coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    df = resolved(_csv(spark, path), {"ticker": ("ticker",), "coverage_status": ("coverage_status",), "reason": ("reason",)})
    df = df.where(F.length(F.trim("ticker")) > 0)
    if df.isEmpty():
        raise DataError("no coverage rows")
    twice = df.groupBy("ticker").count().where("count > 1").limit(3).collect()
    if twice:
        raise DataError(f"repeated tickers: {[r['ticker'] for r in twice]}")
    return df


def screening_json(spark: SparkSession, path: str) -> DataFrame:
    """The screening rows of a report, each with its result's analysis date if the report has results."""
    df = spark.read.option("multiLine", True).json(path)
    rows = df.select(F.explode("screening").alias("s")).select("s.*")
    if "results" not in df.columns or "analysis_date" in rows.columns:
        return rows
    found = df.select(F.explode("results").alias("r")).select(F.col("r.ticker").alias("ticker"), to_day("r.analysis_date").alias("analysis_date"))
    return rows.join(found.dropDuplicates(["ticker"]), "ticker", "left")


def adv_csv(spark: SparkSession, path: str) -> DataFrame:
    """ticker, adv: average daily values; a row without either is an error."""
    df = resolved(_csv(spark, path), {"ticker": COMPANY["ticker"], "adv": ("adv", "average_daily_value")})
    df = df.select(F.trim("ticker").alias("ticker"), to_number("adv").alias("adv"))
    if not df.where("ticker IS NULL OR adv IS NULL").isEmpty():
        raise DataError("rows without ticker or adv")
    return df


def disclosed_csv(spark: SparkSession, path: str) -> DataFrame:
    """ticker, disclosure_date: when a ticker's statements became known, the last line of each."""
    df = resolved(_csv(spark, path).withColumn("__at", _place()), {"ticker": COMPANY["ticker"], "date": ("disclosure_date", "date"), "seq": ("__at",)})
    w = Window.partitionBy(F.trim("ticker")).orderBy(F.desc("seq"))
    return df.withColumn("k", F.row_number().over(w)).where("k = 1 AND ticker IS NOT NULL").select(F.trim("ticker").alias("ticker"), to_day("date").alias("disclosure_date"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet store by month as sinks.bar_store() writes it, or None if there is none yet."""
    return spark.read.parquet(path).drop("month") if _exists(spark, path) else None


def numeric_means(spark: SparkSession, path: str) -> DataFrame:
    """name, mean of the CSV's columns of which every cell is a number."""
    df = _csv(spark, path)
    if not df.columns:
        return spark.createDataFrame([], "name string, mean double")
    x = {c: to_number(F.col(f"`{c}`")) for c in df.columns}
    one = df.agg(*[F.when(F.count(v) == F.count("*"), F.avg(v)).alias(f"c{i}") for i, v in enumerate(x.values())])
    pairs = ", ".join("'" + c.replace("'", "\\'") + f"', c{i}" for i, c in enumerate(x))
    return one.select(F.expr(f"stack({len(x)}, {pairs}) AS (name, mean)")).where("mean IS NOT NULL")


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """metric, date, value from a wide CSV with a date column."""
    df = _csv(spark, path)
    names = [c for c in df.columns if c.strip().lower() != "date"]
    date = next(c for c in df.columns if c.strip().lower() == "date")
    return df.select(to_day(date).alias("date"), F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', `{c}`" for c in names) + ") AS (metric, v)")).select("metric", "date", to_number("v").alias("value"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """line, entry_hash, parent_hash, body of a JSON-lines ledger; a line that is no JSON is an error."""
    rows = _numbered(spark.read.text(path).select("value", _place().alias("__at"))).where(F.length(F.trim("value")) > 0)
    bad = rows.where(F.try_parse_json("value").isNull()).agg(F.min("line").alias("line")).first()["line"]
    if bad is not None:
        raise DataError(f"line {bad} is no JSON")
    field = lambda n: F.get_json_object("value", f"$.{n}").alias(n)
    return rows.select("line", field("entry_hash"), field("parent_hash"), field("body"))


def rest_rows(fetch: Callable[[dict], dict], query: dict, key: str) -> Iterator[dict]:
    """Rows of a paged source; ``fetch`` does the request, so that tests need no network."""
    page: str | None = None
    while True:
        try:
            got = fetch(query | ({"pagination_key": page} if page else {}))
        except Exception as err:
            raise SourceError(f"the source failed: {type(err).__name__}") from err  # no header or token in the message
        yield from got.get(key, [])
        page = got.get("pagination_key")
        if not page:
            return


def synthetic(spark: SparkSession, n_tickers: int = 12, n_days: int = 160, start: str = "2024-01-01") -> DataFrame:
    """Deterministic bars on weekdays, from hashes."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{start}' + INTERVAL {n_days * 2} DAYS)) AS date").where(F.weekday("date") < 5)
    days = days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("i") < n_days)
    t = spark.range(n_tickers).select(F.format_string("%04d", F.col("id") + 1000).alias("ticker"), F.col("id"))
    noise = F.pmod(F.xxhash64("ticker", "i"), F.lit(1000)) / 1000.0 - 0.5
    close = 100 + F.col("id") * 10 + F.col("i") * 0.1 + F.sin(F.col("i") / 9.0) * 5 + noise
    return t.join(F.broadcast(days)).select("ticker", "date", close.alias("open"), (close * 1.01).alias("high"), (close * 0.99).alias("low"), close.alias("close"), F.lit(None).cast("double").alias("adj_close"), (1000 + F.col("i") * 10).cast("double").alias("volume"))


READERS: dict[str, Callable] = {"prices": prices_csv, "statements": statements_csv, "companies": companies_csv, "texts": texts_dir, "quotes": quotes_json, "statements_json": statements_json, "listed": listed_json, "export": export_dir, "universe": universe_file, "store": bar_store, "coverage": coverage_csv, "screening": screening_json, "series": series_csv, "ledger": ledger, "adv": adv_csv, "vendor": vendor_rows_json}
#: Sources that are named but not served.
STUBS = ("edinet", "tdnet", "news")


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind in STUBS:
        raise SourceError(f"the source {kind} is not available")
    if kind not in READERS:
        raise DataError(f"unknown source {kind}; known are {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


def listed_match(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """Universe with the listed master's names; ``matched`` tells whether there is one."""
    one = listed.select(code_suffixed("ticker").alias("code"), "company_name", "sector", "market").dropDuplicates(["code"])
    j = universe.select("ticker", code_suffixed("ticker").alias("code")).join(one, "code", "left")
    return j.select("ticker", "company_name", "sector", "market", F.col("company_name").isNotNull().alias("matched"))
