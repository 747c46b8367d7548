"""Streams of events to daily bars, and keyed upserts of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Daily bars by user from events (user_id, ts, value); a day closes when the watermark has passed it.

    The watermark needs a timestamp with a zone; ts without one is taken as UTC.
    """
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,4)").alias("value")).withWatermark("ts", delay)
    g = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("turnover"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"))
    return g.select("user_id", F.to_date("w.start").alias("date"), "turnover", "high", "low", "volume")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a store holds whole, in order: each has a marker, made after its rows."""
    fs, p = _fs(spark, f"{path}/committed")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def read_store(spark: SparkSession, path: str, by: str = "date") -> DataFrame | None:
    """The store's rows: of each part those that the last committed batch wrote for it; None if nothing is committed."""
    done = committed(spark, path)
    if not done:
        return None
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={k}" for k in done])
    last = rows.groupBy(by).agg(F.max("batch").alias("batch"))  # a row for each part
    return rows.join(F.broadcast(last), [by, "batch"], "left_semi").drop("batch")


def upsert_into(path: str, keys: list[str], by: str = "date"):
    """A foreachBatch function that merges a batch into a Parquet store with a folder for each batch and part.

    A batch's rows replace stored ones of the same keys, of which ``by`` is
    one. Only parts that the batch touches are read and written, to a folder of
    the batch's own; a marker then makes it count. So readers see whole
    batches alone, nothing stored is ever deleted for it, and a batch that runs
    again after a failure is either done already or written anew.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed(spark, path):
            return
        both = batch.withColumn("__new", F.lit(1))
        old = read_store(spark, path, by)
        if old is not None:
            touched = batch.select(by).distinct()
            both = both.unionByName(old.join(touched, by, "left_semi").withColumn("__new", F.lit(0)))
        last = both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new")))).where("__k = 1").drop("__k", "__new")
        last.write.mode("overwrite").partitionBy(by).parquet(f"{path}/rows/batch={batch_id}")
        fs, p = _fs(spark, f"{path}/committed/{batch_id}")
        fs.create(p, True).close()

    return put


def vacuum(spark: SparkSession, path: str, by: str = "date") -> int:
    """Delete the parts that a later committed batch wrote anew, when no reader is at work; their number."""
    done = committed(spark, path)
    seen, gone = set(), 0
    for k in reversed(done):
        fs, p = _fs(spark, f"{path}/rows/batch={k}")
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name.startswith(f"{by}="):
                gone += name in seen and fs.delete(f.getPath(), True)
                seen.add(name)
    return gone


def run_daily(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str) -> DataFrame:
    """Read a folder of event files as a stream, once through, and return the store."""
    events = spark.readStream.schema(schema).parquet(source)
    q = daily_bars(events).writeStream.outputMode("update").foreachBatch(upsert_into(store, ["user_id", "date"])).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = read_store(spark, store)
    return rows if rows is not None else daily_bars(spark.createDataFrame([], schema))
