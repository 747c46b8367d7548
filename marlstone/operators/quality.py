"""Checks and upkeep of bar stores: coverage, completeness, consistency, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bar_quality(bars: DataFrame) -> DataFrame:
    """One row of counts over all bars."""
    per_key = bars.groupBy("ticker", "date").agg(F.count("*").alias("n"), *[F.max((F.col(c) <= 0).cast("int")).alias(f"bad_{c}") for c in ("open", "high", "low", "close")], F.sum((F.col("volume") == 0).cast("int")).alias("zero_volume"), F.sum((F.col("turnover_value") == 0).cast("int")).alias("zero_turnover"), F.sum((F.abs(F.col("adjustment_factor") - 1) > 1e-12).cast("int")).alias("adjusted"))
    per_date = per_key.groupBy("date").agg(F.count("*").alias("tickers"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("surplus"), *[F.sum(f"bad_{c}").alias(f"bad_{c}") for c in ("open", "high", "low", "close")], F.sum("zero_volume").alias("zero_volume"), F.sum("zero_turnover").alias("zero_turnover"), F.sum("adjusted").alias("adjusted"))
    out = per_date.agg(F.sum("n").alias("n_rows"), F.sum("surplus").alias("duplicate_keys"), F.count("*").alias("n_dates"), F.min("tickers").alias("min_tickers"), F.max("tickers").alias("max_tickers"), *[F.sum(f"bad_{c}").alias(f"nonpositive_{c}") for c in ("open", "high", "low", "close")], F.sum("zero_volume").alias("zero_volume"), F.sum("zero_turnover").alias("zero_turnover"), F.sum("adjusted").alias("adjusted_rows"))
    return out.withColumn("status", F.when((F.col("duplicate_keys") > 0) | (F.col("nonpositive_close") > 0), "warning").otherwise("ok"))


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known and missing values per column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return one.select("n", F.expr("stack(" + str(len(columns)) + ", " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (field, known)")).select("field", F.col("known").alias("n_known"), (F.col("n") - F.col("known")).alias("n_missing"), (F.col("known") / F.nullif(F.col("n"), F.lit(0))).alias("ratio"))


def store_check(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: rows, tickers, dates, duplicates, short histories and missing tickers."""
    per = bars.groupBy("ticker", "date").agg(F.count("*").alias("n")).groupBy("ticker").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), F.min("date").alias("first"), F.max("date").alias("last"))
    all_ = universe.select("ticker").distinct().withColumn("wanted", F.lit(1)).join(per, "ticker", "full_outer")
    n = F.coalesce("n", F.lit(0))
    return all_.agg(F.sum(n).alias("n_rows"), F.count("n").alias("n_tickers"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_keys"), F.min(n).alias("min_rows"), F.max(n).alias("max_rows"), *[F.sum((n < k).cast("int")).alias(f"below_{k}") for k in (6, 21, 61)], F.sum((F.col("wanted").isNotNull() & F.col("n").isNull()).cast("int")).alias("missing_tickers"))


def latest_eligible_dates(bars: DataFrame, universe: DataFrame, horizons=(5, 20, 60)) -> DataFrame:
    """Per horizon the latest date after which every ticker of the universe still has enough bars.

    A ticker with h + 1 later rows at a date has it up to its (h + 2)-th last
    date less a day; the least of these over tickers bounds the dates of all.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = bars.join(universe.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "date", F.row_number().over(back).alias("k"))
    # The date of a ticker's (h + 1)-th last row: any earlier date has h + 1 rows after it.
    cut = rows.groupBy("ticker").agg(*[F.max(F.when(F.col("k") == h + 1, F.col("date"))).alias(f"cut_{h}") for h in horizons])
    all_ = universe.select("ticker").distinct().join(cut, "ticker", "left")
    least = all_.agg(*[F.when(F.count("*") == F.count(f"cut_{h}"), F.min(f"cut_{h}")).alias(f"cut_{h}") for h in horizons])
    dates = bars.select("date").distinct().crossJoin(F.broadcast(least))  # one row
    found = dates.agg(*[F.max(F.when(F.col("date") < F.col(f"cut_{h}"), F.col("date"))).alias(f"d_{h}") for h in horizons])
    return found.select(F.expr("stack(" + str(len(horizons)) + ", " + ", ".join(f"{h}, d_{h}" for h in horizons) + ") AS (horizon, latest_date)"))


def missing_by_date(bars: DataFrame, universe: DataFrame, dates: DataFrame) -> DataFrame:
    """date, n_missing: tickers of the universe without a bar on a date, by counts, not by pairs."""
    n = universe.select("ticker").distinct()
    present = bars.join(n, "ticker", "left_semi").select("date", "ticker").distinct().groupBy("date").agg(F.count("*").alias("present"))
    size = n.agg(F.count("*").alias("n_universe"))
    return dates.select("date").distinct().join(present, "date", "left").crossJoin(F.broadcast(size)).select("date", (F.col("n_universe") - F.coalesce("present", F.lit(0))).alias("n_missing"))


def complete_dates(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Dates on which every ticker of the universe has a bar."""
    return missing_by_date(bars, universe, bars).where("n_missing = 0").select("date")


def consistency(left: DataFrame, right: DataFrame, column: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: rows with both values, largest difference, mismatches."""
    j = left.select("ticker", "date", F.col(column).alias("a")).join(right.select("ticker", "date", F.col(column).alias("b")), ["ticker", "date"]).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.abs(F.col("a") - F.col("b"))
    return j.agg(F.count("*").alias("n_compared"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs_diff"), F.coalesce(F.sum((d > tolerance).cast("int")), F.lit(0)).alias("n_mismatch"))


def dedup(df: DataFrame, keys: list[str], order: list, keep_last: bool = True) -> DataFrame:
    """One row per key, the last or first by ``order``, which must be total."""
    o = [F.col(c).desc() if keep_last else F.col(c).asc() for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).where("__k = 1").drop("__k")


def merge_bars(store: DataFrame, new: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """Store and new rows; a new row replaces a stored one of its key."""
    both = store.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return dedup(both, list(keys), ["__src"]).drop("__src")


def added_keys(before: DataFrame, after: DataFrame, keys=("ticker", "date")) -> DataFrame:
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), list(keys), "left_anti")


def usable(universe: DataFrame, allow_partial: bool = False) -> DataFrame:
    return universe.where(F.col("coverage_status").isin(["full_window"] + (["partial_window"] if allow_partial else [])))


def weekdays(spark, first: str, last: str) -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")
    return days.where(F.weekday("date") < 5)


def status_counts(df: DataFrame, column: str) -> DataFrame:
    """A status column's values and how many rows have each."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def mismatches(left: DataFrame, right: DataFrame, column: str, tolerance: float = 1e-6, first: int | None = None) -> DataFrame:
    """ticker, date, both values and their difference where it is larger than allowed; all, or the ``first`` by ticker and date.

    Of those each task keeps as many, and these are merged: no sort of all rows.
    """
    j = left.select("ticker", "date", F.col(column).alias("a")).join(right.select("ticker", "date", F.col(column).alias("b")), ["ticker", "date"])
    found = j.withColumn("diff", F.abs(F.col("a") - F.col("b"))).where(F.col("diff") > tolerance)
    return found if first is None else found.orderBy("ticker", "date").limit(first)
