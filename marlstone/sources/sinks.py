"""Writers: ordered CSV and JSON reports, partitioned stores, Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quality import dedup
from .scratch import drop, written

#: Rows of a file of an ordered sink.
FILE_ROWS = 1_000_000
MANIFEST = "_manifest.json"
OPTIONAL = ("label", "signal", "sector", "sector_relative_score")


def ordered(df: DataFrame, path: str, order: list[str], kind: str, *, columns: list[str] | None = None, rows: int = FILE_ROWS, **options) -> list[dict]:
    """Write ``df`` in order, as numbered files of about so many rows, and a manifest of them; no task gets all rows.

    A file holds a range of the order, and its name's number is the range's:
    files by name, and lines within them, are the order. The manifest says
    for each file, in order, its name and number of rows, so that a reader
    can tell that all of them are there. ``columns``: what is written, if not
    every column. Options are the format's.
    """
    spark = df.sparkSession
    d, scratch_path = written(df)
    n = d.count()
    d = d.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order)
    d = d.select(*columns) if columns else d
    d.write.mode("overwrite").format(kind).options(**options).save(path)
    drop(spark, scratch_path)
    back = spark.read.format("text" if kind in ("text", "json") else kind).options(**options)
    back = back.schema("value string") if kind in ("text", "json") else back.schema(d.schema)
    # A row for each file.
    files = back.load(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows")).orderBy("file").collect()
    listed = [{"file": r["file"], "rows": r["rows"]} for r in files]
    put_text(spark, f"{path.rstrip('/')}/{MANIFEST}", json.dumps({"order": order, "rows": n, "files": listed}, indent=1))
    return listed


def put_text(spark, path: str, text: str) -> None:
    """A small file in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def ranked_csv(df: DataFrame, path: str, order: list[str], rows: int = FILE_ROWS) -> None:
    """A report as ordered CSV; optional columns only if any row has them."""
    have = df.agg(*[F.count(c).alias(c) for c in OPTIONAL if c in df.columns]).first().asDict() if any(c in df.columns for c in OPTIONAL) else {}
    ordered(df.select(*[c for c in df.columns if have.get(c, 1)]), path, order, "csv", rows=rows, header=True)


def json_report(df: DataFrame, path: str, order: list[str], rows: int = FILE_ROWS) -> None:
    """One JSON object a line, without NULL fields, in order."""
    ordered(df.withColumn("__value", F.to_json(F.struct(*df.columns))), path, order, "text", columns=[F.col("__value").alias("value")], rows=rows)


def bar_store(df: DataFrame, path: str, buckets: int = 8) -> None:
    """A Parquet store by month; of rows that repeat a key the one with the largest ``seq`` counts, or that came last in ``df``.

    A month is written by up to ``buckets`` tasks, a ticker's rows by one.
    """
    seq = df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())
    d = dedup(seq, ["ticker", "date"], ["seq"]).drop("seq").withColumn("month", F.date_format("date", "yyyy-MM"))
    d = d.repartition("month", F.pmod(F.xxhash64("ticker"), F.lit(buckets))).sortWithinPartitions("month", "ticker", "date")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def price_export(df: DataFrame, path: str, field: str = "close", rows: int = FILE_ROWS) -> None:
    """ticker, date, close with an explicit choice of the price; a missing price is an error."""
    if not df.where(F.col(field).isNull()).isEmpty():
        raise ValueError(f"rows without {field}")
    text = F.when(F.col(field) == F.floor(field), F.col(field).cast("bigint").cast("string")).otherwise(F.col(field).cast("string"))
    ordered(df.select("ticker", "date", text.alias("close")), path, ["ticker", "date"], "csv", rows=rows, header=True)


DISCLAIMER = "For research only; not financial advice."


def _cell(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    value = F.format_string("%.4f", F.col(c).cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "").otherwise(value)


def markdown_table(df: DataFrame, path: str, order: list[str], title: str, rows: int = FILE_ROWS) -> None:
    """A report's rows as Markdown, in order: its head in the first file, the disclaimer in the last."""
    spark = df.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(df, c) for c in df.columns]), F.lit(" |"))
    kinds = dict(df.dtypes)
    lines = df.select(F.lit(1).alias("__part"), F.lit(0).alias("__k"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], line.alias("value"))
    frame = spark.createDataFrame([(0, k, x) for k, x in enumerate(head)] + [(2, k, x) for k, x in enumerate(["", DISCLAIMER])], "__part int, __k int, value string")
    frame = frame.select("__part", "__k", *[F.lit(None).cast(kinds[c]).alias(f"__o{i}") for i, c in enumerate(order)], "value")
    ordered(lines.unionByName(frame), path, ["__part", "__k", *[f"__o{i}" for i in range(len(order))]], "text", columns=["value"], rows=rows)


def report(df: DataFrame, folder: str, name: str, order: list[str], title: str | None = None) -> None:
    """A report as CSV, JSON and Markdown: folders ``name``_csv, _json and _md."""
    flat = df.select(*[c for c, k in df.dtypes if not k.startswith(("array", "struct", "map"))])
    ranked_csv(flat, f"{folder}/{name}_csv", order)
    json_report(df, f"{folder}/{name}_json", order)
    markdown_table(flat, f"{folder}/{name}_md", order, title or name)


#: Heads of a ticker's report and the columns below each.
SECTIONS = (
    ("Scores", ("final_score", "score_confidence", "screening_score", "grade", "label", "rank")),
    ("Parts", ("quality_score", "growth_score", "valuation_score", "momentum_score", "disclosure_score")),
    ("Fundamentals", ("operating_margin", "roe", "equity_ratio", "revenue_growth_yoy")),
    ("Valuation", ("per", "pbr", "dividend_yield", "valuation_class")),
    ("Momentum", ("ret_3m", "ret_6m", "ret_12m", "volatility", "max_drawdown")),
    ("Risk", ("risk_score", "risk_confidence")),
)


def ticker_markdown(df: DataFrame) -> DataFrame:
    """ticker, body: a Markdown report of each row."""
    parts = [F.concat(F.lit("# "), F.col("ticker"), F.coalesce(F.concat(F.lit(" "), F.col("company_name")), F.lit("")) if "company_name" in df.columns else F.lit(""))]
    for head, names in SECTIONS:
        parts.append(F.lit(f"\n## {head}\n"))
        for n in (n for n in names if n in df.columns):
            parts.append(F.concat(F.lit(f"- {n}: "), F.when(F.col(n).isNull(), "not available").otherwise(_cell(df, n))))
    if "warnings" in df.columns:
        parts.append(F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Warnings\n\n- "), F.array_join("warnings", "\n- "))))
    return df.select("ticker", F.concat_ws("\n", *parts, F.lit(f"\n{DISCLAIMER}")).alias("body"))


def ticker_reports(df: DataFrame, folder: str) -> None:
    """A folder ticker=<code> with a Markdown file for every row, written by the tasks that have it."""
    ticker_markdown(df).write.mode("overwrite").partitionBy("ticker").option("lineSep", "\n").text(folder)


def json_file(value: object, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
