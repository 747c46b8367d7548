"""Column functions with this library's rules for missing data, ties and rounding.

Missing is NULL, never zero. Denominators are guarded, so that nothing divides
by zero and no NaN appears. Ranks share ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nn(x: Column | str) -> Column:
    """NULL instead of zero, for denominators."""
    return F.nullif(col(x), F.lit(0.0))


def safe_div(a: Column | str, b: Column | str) -> Column:
    return col(a) / nn(b)


def pct_change(now: Column | str, before: Column | str) -> Column:
    """Percent of the absolute earlier value."""
    return (col(now) - col(before)) / nn(F.abs(col(before))) * 100


def yoy(now: Column | str, before: Column | str) -> Column:
    """Percent of the signed earlier value."""
    return (col(now) - col(before)) / nn(before) * 100


def scale(v: Column | str, low: float, high: float) -> Column:
    """0 at ``low`` to 100 at ``high``, held within; NULL stays NULL."""
    return F.when(col(v).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(v) - low) / (high - low))) * 100)


def inverted(v: Column | str, low: float, high: float) -> Column:
    return 100 - scale(v, low, high)


def clamp(v: Column | str, low: float, high: float) -> Column:
    return F.when(col(v).isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(v))))


def mean_of(*values: Column) -> Column:
    """Mean of those that aren't NULL, added in this order; NULL if none is left."""
    total, n = F.lit(0.0), F.lit(0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
        n = n + v.isNotNull().cast("int")
    return total / F.nullif(n, F.lit(0))


def count_of(*values: Column) -> Column:
    n = F.lit(0)
    for v in values:
        n = n + v.isNotNull().cast("int")
    return n


def r6(x: Column | str) -> Column:
    return F.round(col(x), 6)


def average_rank(value: Column | str, *keys: str, ascending: bool = True) -> Column:
    """Rank within keys, ties sharing their mean rank; NULL for NULL."""
    v = col(value)
    order = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    ties = F.count("*").over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2.0)


def ranked_overall(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the rank of ``value`` over all rows, ties sharing their mean rank; NULL for NULL.

    No task orders all rows: distinct values are counted, ranges of them are
    numbered apart, and a row per range carries the numbers over.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Any cuts give the same result; these give ranges of about the same size.
    cuts = sorted(set(df.select(F.col(value).cast("double").alias("__v")).approxQuantile("__v", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    over = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: F.col("__v").cast("double") > c))
    counts = counts.withColumn("__range", over)
    w = Window.partitionBy("__range").orderBy("__v")
    # A row per range.
    totals = counts.groupBy("__range").agg(F.sum("__n").alias("t"))
    before = totals.select("__range", F.coalesce(F.sum("t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranks = counts.withColumn("__upto", F.sum("__n").over(w)).join(F.broadcast(before), "__range")
    ranks = ranks.select("__v", (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NULL for fewer than two pairs or without variance."""
    x, y = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(x) >= 2) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def full(agg: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A windowed aggregate where the window holds ``n`` values, else NULL."""
    return F.when(F.count(counted).over(w) >= n, agg.over(w))


def score_bucket(v: Column | str) -> Column:
    """Tens from 0-10 to 90-100; NULL is ``none``."""
    low = F.least(F.lit(90), (F.floor(clamp(v, 0, 100) / 10) * 10).cast("int"))
    return F.when(col(v).isNull(), "none").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string")))


def code_padded(c: Column | str) -> Column:
    """Five digits that end in 0 lose it; shorter digits get zeros to four."""
    c = F.trim(col(c))
    return F.when(c.rlike(r"^\d{4}0$"), F.substring(c, 1, 4)).when(c.rlike(r"^\d{1,3}$"), F.lpad(c, 4, "0")).otherwise(c)


def code_vendor(c: Column | str) -> Column:
    """As code_padded, also for longer codes: a ticker of five digits or more and a 0 lose the 0."""
    c = F.trim(col(c))
    return F.when(c.rlike(r"^\d{5,}0$"), F.regexp_replace(c, "0$", "")).otherwise(code_padded(c))


def code_suffixed(c: Column | str) -> Column:
    """Upper case without a market suffix .T."""
    return F.regexp_replace(F.upper(F.trim(col(c))), r"\.T$", "")


def code_four(c: Column | str) -> Column:
    c = F.trim(col(c))
    return F.when(c.rlike(r"^\d{4}0$"), F.substring(c, 1, 4)).otherwise(c)


def code_lettered(c: Column | str) -> Column:
    """As code_four, also for three digits, a letter and 0."""
    c = F.trim(col(c))
    return F.when(c.rlike(r"^\d{4}0$|^\d{3}[A-Z]0$"), F.substring(c, 1, 4)).otherwise(c)


def to_number(c: Column | str) -> Column:
    """A double from text that may have thousands separators; NULL if it is none."""
    return F.replace(F.trim(col(c)), F.lit(","), F.lit("")).try_cast("double")


def to_day(c: Column | str) -> Column:
    """A date from one of three forms; NULL if it is none."""
    t = F.trim(col(c))
    parsed = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")]
    return F.coalesce(*parsed)


def _step(name: str) -> str:
    """A field's name as a step of a path, whatever signs are in it (but a quote and a bracket together)."""
    return f"['{name}']" if '"' in name else f'["{name}"]'


def variant_field(v: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT by its dotted path, as ``kind``; NULL if it isn't there or isn't of that kind."""
    return F.try_variant_get(col(v), "$" + "".join(map(_step, path.split("."))), kind)


def variant_text(v: Column | str, *names: str) -> Column:
    """The first of several fields of a VARIANT that is there and not blank, as text without spaces around."""
    found = [F.nullif(F.trim(F.try_variant_get(col(v), "$" + _step(n), "string")), F.lit("")) for n in names]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys and no spaces; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(col(c)))


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), r"[.。\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def occurrences(text: Column | str, word: Column | str) -> Column:
    """Non-overlapping occurrences of a plain word."""
    t, w = col(text), col(word)
    return ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")


def python_round(values, digits: int):
    """Half-even on the exact binary value, as reports print it; for a pandas Series."""
    return values.map(lambda v: None if v is None or v != v else round(float(v), digits))
