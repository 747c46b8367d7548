"""A resumable backfill of dated vendor rows into a store, run by run.

A run is a micro-batch over the dated source: at most so many dates, failed
ones first. What came is written as it is before it is worked on, so that one
run asks once; then the new rows, the dates' outcomes and, last, a marker that
makes the batch count. A run that is killed is done again over the same dates.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import code_four, to_day, variant_text
from ..sources import dated
from .upsert import _fs, committed

#: What tells summaries apart.
KEYS = ("DiscNo", "Code", "DiscDate", "DocType")
ROWS = "ticker string, query_date date, fields variant, batch long, disclosed date"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """ticker, query_date, fields, batch, disclosed of all committed batches."""
    done = committed(spark, path)
    if not done:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={k}" for k in done])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The run log: batch, nth, date, outcome (rows, empty, failed, skipped), reason, detail, n_rows, added, attempts, latest."""
    kind = "nth int, date date, outcome string, reason string, detail string, n_rows long, added long, attempts int, latest date, batch long"
    done = committed(spark, path)
    if not done:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", f"{path}/state").json([f"{path}/state/batch={k}" for k in done])


def land(path: str, universe: DataFrame, keys: tuple[str, ...] = KEYS):
    """The foreachBatch function of a run.

    Only the universe's rows are kept. Of rows with the same keys the first
    counts: stored ones, then those of earlier dates of the run, then earlier
    rows of a date; keys that a row lacks are compared as nulls. Dates after
    one that is outside the subscription are left for another run.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed(spark, path):
            return
        batch.write.mode("overwrite").parquet(f"{path}/landed/batch={batch_id}")
        raw = spark.read.schema(dated.SCHEMA).parquet(f"{path}/landed/batch={batch_id}")
        stop = raw.where(F.col("reason") == dated.OUTSIDE).agg(F.min("nth")).first()[0]
        if stop is not None:
            raw = raw.where(F.col("nth") <= stop)
        v = raw.where("row IS NOT NULL").select("date", "nth", "seq", F.parse_json("row").alias("fields"))
        v = v.select("*", code_four(variant_text("fields", "Code")).alias("ticker"), to_day(variant_text("fields", "DiscDate", "DisclosedDate")).alias("disclosed"), *[variant_text("fields", k).alias(f"k{i}") for i, k in enumerate(keys)])
        names = [f"k{i}" for i in range(len(keys))]
        v = v.join(universe.select("ticker").distinct(), "ticker", "left_semi")
        first = Window.partitionBy(*names).orderBy("nth", "seq")
        v = v.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        old = read_rows(spark, path)
        # Equal rows have the same day: only its folders are read.
        old = old.join(v.select("disclosed").distinct().withColumnRenamed("disclosed", "d"), F.col("disclosed").eqNullSafe(F.col("d")), "left_semi").select(*[variant_text("fields", k).alias(f"o{i}") for i, k in enumerate(keys)])
        same = [F.col(n).eqNullSafe(F.col(f"o{i}")) for i, n in enumerate(names)]
        new = v.join(old, same, "left_anti")
        new.select("ticker", F.col("date").alias("query_date"), "fields", "disclosed").write.mode("overwrite").partitionBy("disclosed").parquet(f"{path}/rows/batch={batch_id}")
        added = spark.read.schema("query_date date, disclosed date").option("basePath", f"{path}/rows/batch={batch_id}").parquet(f"{path}/rows/batch={batch_id}")
        added = added.groupBy(F.col("query_date").alias("date")).agg(F.count("*").alias("added"), F.max("disclosed").alias("latest"))
        day = raw.groupBy("nth", "date").agg(F.max("reason").alias("reason"), F.max("detail").alias("detail"), F.count("row").alias("n_rows"), F.max("attempts").alias("attempts"))
        outcome = F.when(F.col("reason").isNull(), "rows").when(F.col("reason") == dated.EMPTY, "empty").when(F.col("reason") == dated.OUTSIDE, "skipped").otherwise("failed")
        # A row for each date of the run.
        log = day.join(added, "date", "left").select("nth", F.col("date").cast("string").alias("date"), outcome.alias("outcome"), "reason", "detail", "n_rows", F.coalesce("added", F.lit(0)).alias("added"), "attempts", F.col("latest").cast("string").alias("latest"))
        log.coalesce(1).write.mode("overwrite").json(f"{path}/state/batch={batch_id}")
        fs, p = _fs(spark, f"{path}/committed/{batch_id}")
        fs.create(p, True).close()

    return put


def run(spark: SparkSession, path: str, universe: DataFrame, *, first: datetime.date | str, last: datetime.date | str | None = None, cap: int = 20, keys: tuple[str, ...] = KEYS, key_env: str | None = None, **options) -> DataFrame:
    """One run: at most ``cap`` dates; further options are the source's. Returns the store's rows."""
    dated.register(spark, key_env)
    source = spark.readStream.format(dated.NAME).options(**{k: str(v) for k, v in options.items()}, failures="rows", first=str(first), state=path, cap=str(cap))
    if last is not None:
        source = source.option("last", str(last))
    q = source.load().writeStream.foreachBatch(land(path, universe, keys)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_rows(spark, path)


def coverage(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Each ticker of the universe, and whether the store has any of its rows."""
    has = rows.select("ticker").distinct().withColumn("has_summary", F.lit(True))
    return universe.select("ticker").distinct().join(has, "ticker", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def summary(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """One row: how the last run went, and what the store holds."""
    log = read_state(spark, path)
    last = log.agg(F.max("batch").alias("last"))
    run_ = log.join(F.broadcast(last), F.col("batch") == F.col("last"))
    names = lambda what: F.sort_array(F.collect_list(F.when(what, F.col("date")))).alias
    failed = F.col("outcome") == "failed"
    one = run_.agg(
        F.max("batch").alias("batch"),
        names(F.lit(True))("dates"),
        names(F.col("outcome").isin("rows", "empty"))("done"),
        names(failed)("failed"),
        names(failed & ~F.col("reason").isin(*dated.FINAL))("carried_over"),
        names(F.col("outcome") == "skipped")("skipped"),
        names(F.col("outcome") == "empty")("empty"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("rows_added"),
    )
    rows = read_rows(spark, path)
    held = rows.agg(F.count("*").alias("rows_saved"), F.max("disclosed").alias("latest_disclosed"))
    missing = coverage(rows, universe).agg(F.count_if(~F.col("has_summary")).alias("without_summary"), F.count_if("has_summary").alias("with_summary"))
    return one.join(held).join(missing)  # three tables of one row
