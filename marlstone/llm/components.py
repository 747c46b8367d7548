"""Connected components of an edge table, in rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: A key that more than one row in so many has is frequent; there can be no more such keys than this.
FREQUENT = 1000
#: Rows (some 30 bytes each) up to which a table is small enough to be sent to all tasks whole.
SMALL_ROWS = 200_000


def by_key(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has each key once and in __n how many rows of ``big`` have it.

    ``rows`` is the number of rows of ``big``, and so at least that of
    ``small``: up to ``SMALL_ROWS`` of them ``small`` is sent to all tasks.
    Beyond that, keys that more than a thousandth of the rows have, fewer than
    a thousand keys, are sent to all tasks, so that no task gets all rows of
    one of them; the rest is shuffled.
    """
    if rows <= SMALL_ROWS:
        return big.join(F.broadcast(small.drop("__n")), key, how)
    often = small.where(F.col("__n") > rows // FREQUENT).drop("__n")
    rest = small.where(F.col("__n") <= rows // FREQUENT).drop("__n")
    hot = big.join(F.broadcast(often), key)
    cold = big.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key, how)
    return hot.unionByName(cold)


def star_edges(members: DataFrame) -> DataFrame:
    """(u, v) from each node v of a key to the key's least node u; ``members`` has key, node.

    Keys are counted with partial sums and frequent ones joined where their
    rows are, so that none costs a task more than others.
    """
    keys = members.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("__n")).where("__n > 1")
    return by_key(members, keys, "key", members.count()).where("node <> u").select("u", F.col("node").alias("v")).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (u, v).

    Large and small stars alternate: each node's larger neighbours, then its
    smaller ones, are joined to the least node known. What a round yields is
    written to the shared folder. It ends when nothing changes, after a number
    of rounds that grows with the logarithm of the largest component.
    """
    spark = edges.sparkSession
    # Sums of hashes tell whether the edges are the same, without a join.
    sign = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())  # u > v
    known = sign(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).select("u", F.least("u", "m").alias("m"), "__n")
        large, large_path = written(by_key(both, least, "u", 2 * known["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = by_key(large, low, "u", large.count()).select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        after, new = written(small)
        found = sign(after)
        drop(spark, path, large_path)
        same, now, path, known = found == known, after, new, found
        if same:
            # All edges now go from a node to its component's least node.
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
