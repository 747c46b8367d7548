"""What each of several filters removes, alone, after others, and in every order of them.

Four filters look at a row alone; the last one removes a text that a smaller
doc_id has too. Which rows that is says a left semi join on the text's hash,
the exact text and the smaller id; its ids are united with those that the
other filters mark, and rows are counted by the combination of filters that
they fail. Counts for every order follow from those combinations, of which a
part has at most 2 ** filters times four kinds of labels.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, drop, written

#: White space that parts words, and the pattern of a stretch of it.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
#: A hash that more than one row in so many has is split; there are fewer such hashes than this.
FREQUENT = 1000


def words(text: Column) -> Column:
    """Maximal stretches without white space, as they stand."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _few_words(text: Column, n: Column, distinct: Column) -> Column:
    return n < 50


def _repetitive(text: Column, n: Column, distinct: Column) -> Column:
    return 100 * distinct < 65 * n


def _capitals(text: Column, n: Column, distinct: Column) -> Column:
    rest = F.translate(text, UPPER, "")
    return 100 * (F.length(text) - F.length(rest)) > 5 * F.length(text)


def _signs(text: Column, n: Column, distinct: Column) -> Column:
    return F.length(F.translate(text, "#$%&*|", "")) < F.length(text)


#: Filters on a row alone: true where it fails. Arguments are the text, its number of words and of distinct words.
ROW_FILTERS: dict[str, Callable[[Column, Column, Column], Column]] = {"A": _few_words, "B": _repetitive, "C": _capitals, "D": _signs}
#: The filter on copies.
COPIES = "E"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def copies(texts: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """Rows of ``texts`` (doc_id, part, h, text) whose very text a row with a smaller doc_id has: doc_id, part, h.

    ``repeated`` (h, n) has the hashes of more than one doc_id. All texts are
    dealt once by their hash, to keep those of repeated hashes alone; a hash
    with more than a thousandth of the rows is dealt to as many places as it
    has thousandths, and only those hashes, fewer than a thousand, are sent to
    all tasks. Each place gets one text for all copies, that of the least
    doc_id, found with partial sums; so no row meets more than one partner
    (or as many as there are texts with one hash).
    """
    spark = texts.sparkSession
    pieces = F.ceil(F.col("n") * FREQUENT / total).cast("int")
    split = F.broadcast(repeated.where(F.col("n") * FREQUENT > total).select("h", pieces.alias("pieces")))
    dealt = texts.where("doc_id IS NOT NULL").join(split, "h", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    places = F.explode(F.sequence(F.lit(0), F.when(F.col("n") * FREQUENT > total, pieces).otherwise(1) - 1))
    wanted = repeated.select("h", places.alias("piece")).hint("shuffle_hash")
    rows, path = written(dealt.join(wanted, ["h", "piece"]))
    least = rows.groupBy("h", "text", "pieces").agg(F.min("doc_id").alias("least"))
    least = least.select("h", "text", "least", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    a, b = rows.alias("a"), least.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.text") == F.col("b.text"))
    found, out = written(a.join(b, same & (F.col("b.least") < F.col("a.doc_id")), "left_semi").select("doc_id", "part", "h"))
    drop(spark, path)
    return found


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source", digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """part, bits (1 for the first filter, 2 for the second and so on), good, toxic and n, the number of rows so."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    texts = texts.withColumn("h", digest(F.col("text")))
    w = texts.select("doc_id", "part", "h", "text", words(F.col("text")).alias("w"))
    w = w.select("doc_id", "part", "h", "text", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d"))
    bits = F.lit(0)
    for k, fails in enumerate(ROW_FILTERS.values()):
        bits = bits.bitwiseOR(F.when(fails(F.col("text"), F.col("n"), F.col("d")), 1 << k).otherwise(0))
    marks, path = written(w.select("doc_id", "part", "h", bits.alias("bits")))
    total = max(1, marks.count())
    several = (F.min("doc_id") < F.max("doc_id")).alias("several")
    repeated, groups = written(marks.where("doc_id IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), several).where("several").select("h", "n"))
    again = copies(texts, repeated, total)
    every = marks.select("doc_id", "part", "h", "bits", F.lit(1).alias("n")).unionByName(again.select("doc_id", "part", "h", F.lit(1 << len(ROW_FILTERS)).alias("bits"), F.lit(0).alias("n")))
    # Repeated rows have the same key and fail the same filters: they count as often as they stand there.
    rows = every.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    # A doc_id has at most one row for each part and combination here, null ones too: the join has no hot key.
    rows = rows.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    seen = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    seen = seen.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    kinds = rows.join(seen, "doc_id", "left").select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    out, _ = written(kinds.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n")))
    drop(spark, path, groups)
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """How the filters interact, per value of ``part``, order of filters and step of that order.

    ``docs`` has doc_id, text and the column named by ``part``; ``labels`` has
    doc_id, quality and toxic. Columns: part, filter_order, step (from 1; its
    filter is that letter of the order), and numbers of rows of the part: kept
    after the step; removed by it; redundant: failing its filter, but removed
    before; unique_fails: failing its filter alone; good_lost and toxic_lost:
    removed here, labelled good or toxic; shapley: removed by its filter, at
    any step, summed over all orders.

    A null text is an empty one: it has no words, and a smaller doc_id with an
    empty or null text makes it a copy. A null part is the empty string. Rows
    count one by one: repeated rows of one doc_id are no copies of each other
    (no doc_id is smaller), and a row without doc_id is neither a copy nor
    makes one, and has no labels. Copies are found over the whole table,
    whatever the part and other filters. A doc_id labelled several times is
    good, or toxic, if one label says so. Ties cannot occur. An empty table
    gives no rows; further columns, of any name, are ignored.
    """
    letters = [*ROW_FILTERS, COPIES]
    orders = F.explode(F.lit(["".join(o) for o in itertools.permutations(letters)]))
    parts = combinations(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("bits", "good", "toxic", "n")).alias("kinds"))
    rows = parts.select("part", "kinds", orders.alias("filter_order")).withColumn("step", F.explode(F.lit(list(range(1, len(letters) + 1)))))

    def mask(named: Column) -> Column:
        return functools.reduce(operator.add, [F.when(F.contains(named, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(letters)])

    rows = rows.withColumn("bit", mask(F.expr("substr(filter_order, step, 1)"))).withColumn("before", mask(F.expr("substr(filter_order, 1, step - 1)")))
    bit_, before = F.col("bit"), F.col("before")

    def number(when: Callable[[Column], Column], times: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda s, x: s + F.when(when(x), times(x)).otherwise(0).cast("long"))

    fails = lambda x: x["bits"].bitwiseAND(bit_) != 0
    earlier = lambda x: x["bits"].bitwiseAND(before) != 0
    here = lambda x: fails(x) & ~earlier(x)
    # A row that fails k filters is removed by each of them in one of k orders.
    shares = F.lit([math.factorial(len(letters)) // k for k in range(1, len(letters) + 1)])
    share = lambda x: x["n"] * F.element_at(shares, F.bit_count(x["bits"]))
    return rows.select(
        "part",
        "filter_order",
        "step",
        number(lambda x: ~fails(x) & ~earlier(x)).alias("kept"),
        number(here).alias("removed"),
        number(lambda x: fails(x) & earlier(x)).alias("redundant"),
        number(lambda x: x["bits"] == bit_).alias("unique_fails"),
        number(lambda x: here(x) & x["good"]).alias("good_lost"),
        number(lambda x: here(x) & x["toxic"]).alias("toxic_lost"),
        number(fails, share).alias("shapley"),
    )
