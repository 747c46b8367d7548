"""Incremental upkeep of a bar store from a dated source."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quality import added_keys, complete_dates, merge_bars, weekdays
from .readers import DataError, SourceError


def with_retry(fetch: Callable, *args, retries: int = 3, wait: float = 1.0, growth: float = 2.0, sleep: Callable = time.sleep):
    """Call until it answers; waits grow by ``growth`` (1 keeps them). The last failure is raised."""
    for k in range(retries + 1):
        try:
            return fetch(*args)
        except SourceError:
            if k == retries:
                raise
            sleep(wait)
            wait *= growth


def due_dates(store: DataFrame | None, universe: DataFrame, first: str, last: str, spark: SparkSession, carried: list[datetime.date] = ()) -> list[datetime.date]:
    """Weekdays without all tickers of the universe, after those carried over from failures; one row a day."""
    days = weekdays(spark, first, last)
    if store is not None:
        days = days.join(complete_dates(store, universe), "date", "left_anti")
    found = [r["date"] for r in days.orderBy("date").collect()]
    return list(dict.fromkeys([*carried, *found]))


def update(spark: SparkSession, store: DataFrame | None, universe: DataFrame, dates: list[datetime.date], fetch: Callable[[datetime.date], DataFrame], *, price_field: str = "close", stored_field: str | None = None, stop_on_failure: bool = False, **retry) -> tuple[DataFrame | None, dict]:
    """The store with the dates' rows of the universe, and a log: added, failed, finished dates.

    A store that was built on another price field isn't mixed with this one.
    """
    if stored_field is not None and stored_field != price_field:
        raise DataError(f"the store holds {stored_field}, not {price_field}")
    log: dict = {"done": [], "failed": [], "price_field": price_field}
    new: DataFrame | None = None
    for d in dates:
        try:
            rows = with_retry(fetch, d, **retry)
        except SourceError as err:
            log["failed"].append({"date": str(d), "error": str(err)})
            if stop_on_failure:
                break
            continue
        rows = rows.join(universe.select("ticker").distinct(), "ticker", "left_semi")
        new = rows if new is None else new.unionByName(rows, allowMissingColumns=True)
        log["done"].append(str(d))
    if new is None:
        return store, log | {"added": 0}
    after = new if store is None else merge_bars(store, new)
    log["added"] = after.count() if store is None else added_keys(store, after).count()
    return after, log


def merged(store: DataFrame, new: DataFrame, universe: DataFrame) -> DataFrame:
    """The store with the universe's new rows, which replace stored ones of their keys."""
    return merge_bars(store, new.join(universe.select("ticker").distinct(), "ticker", "left_semi"))


def carry_over(failed: list[datetime.date], last_success: datetime.date | None, latest: datetime.date | None, today: datetime.date, cap: int) -> list[datetime.date]:
    """Dates of the next run: failures first, then from the day after the later of both marks up to today, at most ``cap``."""
    start = max([d for d in (last_success, latest) if d is not None], default=today - datetime.timedelta(days=1)) + datetime.timedelta(days=1)
    days = [start + datetime.timedelta(days=k) for k in range((today - start).days + 1)]
    return list(dict.fromkeys([*failed, *days]))[:cap]


def summaries(parts: list[DataFrame], keys: list[str], universe: DataFrame) -> DataFrame:
    """Parts one after the other; of rows that repeat the keys the first stays; only the universe; each row tells whether its ticker has any."""
    both = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k)).withColumn("__seq", F.monotonically_increasing_id())
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*[c for c in keys if c in both.columns]).orderBy("__part", "__seq")
    kept = both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__part", "__seq")
    u = universe.select("ticker").distinct()
    return u.join(kept.withColumn("has_summary", F.lit(True)), "ticker", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
