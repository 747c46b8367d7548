"""Ranks within keys whose rows one task couldn't sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .semantics import col


#: A key of fewer rows is sorted by one task; ranges of larger ones have about so many.
RANGE_ROWS = 100_000
#: Counts of ranges that are sent to each task at most.
SENT = 1_000_000


def ranks_within(df: DataFrame, keys: list[str], values: dict[str, Column | str], *, ascending: bool = True, method: str = "average") -> DataFrame:
    """Adds the rank of each value within the keys; ties share their mean rank, or their least one (``min``). NULL isn't ranked.

    Where there are many keys of few rows each, rows are moved once, by key.
    Else a key's rows are ranked in ranges of values, between cuts that are
    drawn over all rows, and are moved once for each value; what is before a
    range is a count for each key and range. A value that is a cut is a range
    of its own: all its rows have the same rank, which the counts give, so
    that a frequent value is dealt anywhere and never sorted. Any cuts give
    the same ranks. The rows are written once; sizes, cuts and all counts are
    taken from that table, never from rows that have ranks already.
    """
    if method not in ("average", "min"):
        raise ValueError("method must be average or min")
    names = list(values)
    # A column that is there as a double is not written a second time.
    there = {c for c, kind in df.dtypes if kind == "double"} - set(names)
    v = {n: values[n] if isinstance(values[n], str) and values[n] in there else f"__v{i}" for i, n in enumerate(names)}
    added = {n: c for n, c in v.items() if c not in there}
    base, _ = written(df.select("*", *[col(values[n]).cast("double").alias(c) for n, c in added.items()]))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = base.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    n_keys = max(1, size["keys"])
    ranges = min(parts, max(1, -(-size["most"] // RANGE_ROWS), -(-2 * parts // n_keys)))
    shares = [k / ranges for k in range(1, ranges)]
    # Some hundred numbers for each value at most.
    drawn = base.approxQuantile([v[n] for n in names], shares, 0.25 / ranges) if shares else [[] for _ in names]
    d = base
    for n, cuts in zip(names, drawn):
        x = F.col(v[n])
        if not cuts:
            d = d.withColumn(n, _ranked(x, keys, ascending, method))
            continue
        given = F.lit(sorted(set(cuts))).cast("array<double>")
        place = F.when(x.isNotNull(), _below(given, x) + F.array_contains(given, x).cast("int"))
        counts = base.where(x.isNotNull()).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], place.alias("__c")).agg(F.count("*").alias("__n"))
        # At most two ranges for each cut, and one more, for a key.
        mine = [f"__k{i}" for i in range(len(keys))]
        upto = Window.partitionBy(*mine).orderBy("__c" if ascending else F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        d = d.withColumn("__r", place)
        alone = F.col("__r").isNull() | (F.col("__r") % 2 != 0)
        d = d.withColumn("__s", F.when(alone, F.spark_partition_id()).otherwise(-1)).withColumn("__w", _ranked(x, [*keys, "__r", "__s"], ascending, method)).drop("__s")
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        if n_keys * (2 * len(cuts) + 1) <= SENT:
            table = counts.groupBy(*mine).agg(F.map_from_entries(F.collect_list(F.struct("__c", F.struct("__n", "__before")))).alias("__m"))
            d = d.join(F.broadcast(table), on, "left").withColumn("__f", F.try_element_at("__m", F.col("__r"))).withColumns({"__n": F.col("__f.__n"), "__before": F.col("__f.__before")})
        else:
            d = d.join(counts, on & (F.col("__r") == F.col("__c")), "left")
        shared = (F.col("__n") + 1) / 2.0 if method == "average" else F.lit(1)
        rank = F.when(x.isNotNull(), F.col("__before") + F.when(alone, shared).otherwise(F.col("__w")))
        d = d.withColumn(n, rank if method == "average" else rank.cast("int"))
        d = d.drop("__r", "__w", "__c", "__m", "__f", "__n", "__before", *mine)
    return d.drop(*added.values())


def _ranked(x: Column, keys: list[str], ascending: bool, method: str) -> Column:
    """Ranks among the rows of equal keys, which one task sorts."""
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    rank = F.rank().over(w)
    if method == "average":
        rank = rank + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0
    return F.when(x.isNotNull(), rank)


def _below(cuts: Column, x: Column) -> Column:
    """Twice the number of cuts below x."""
    return 2 * F.size(F.filter(cuts, lambda c: c < x))
