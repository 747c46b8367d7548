"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles.

Vectors are kept as tiles of rows, each row with its int8 form, that form's
scale and norm and the norm of its error. For a tile of queries and a tile of
candidates the product of the int8 forms gives every inner product up to an
error whose bound is known per pair:

    |q.x - sq*sx*(qi.xi)| <= |eq| * |sx*xi| + |q| * |ex|,   e = v - s*vi

A pair whose upper bound is below the query's k-th largest lower bound, or
below the k-th best found so far, can't be among the k nearest. The pairs that
survive are computed again in double precision from the original vectors, and
a heap per query merges the tiles. The result is exact.

Rows are brought to a largest component between 1/2 and 1 by a power of two
first, so that no bound overflows. Where a pair's product might itself
overflow or underflow it is always computed. The vectors travel with their
int8 forms: near copies closer than the error would all survive, and are then
settled where they meet rather than sent on as pairs.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = "kind boolean, dim int, block long, ids binary, small binary, facts binary, data binary"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: not null, not zero, all components finite, with an id. Single precision stays as it is."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


@dataclass
class Tile:
    """rows: the vectors; small: int8 forms of rows / 2**power; scale, back, norm, error: of these."""

    ids: np.ndarray
    rows: np.ndarray
    small: np.ndarray
    power: np.ndarray
    scale: np.ndarray
    back: np.ndarray
    norm: np.ndarray
    error: np.ndarray


def tile_of(ids: np.ndarray, rows: np.ndarray) -> Tile:
    power = np.frexp(np.abs(rows).max(axis=1))[1].astype(np.int64)
    # In two steps, as a power below -1022 is no number of its own.
    x = np.ldexp(np.ldexp(rows.astype(np.float64), (-(power // 2))[:, None]), (-(power - power // 2))[:, None])
    scale = np.abs(x).max(axis=1) / 127.0
    small = np.rint(x / scale[:, None]).astype(np.int8)
    held = small * scale[:, None]
    return Tile(ids, rows, small, power, scale, np.linalg.norm(held, axis=1), np.linalg.norm(x, axis=1), np.linalg.norm(x - held, axis=1))


def bounds(q: Tile, r: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, divided by 2**(the query's power)."""
    dim = q.rows.shape[1]
    wide = np.float32 if dim * 127 * 127 < 2**24 else np.float64  # whole numbers stay exact
    near = (q.small.astype(wide) @ r.small.astype(wide).T).astype(np.float64) * q.scale[:, None] * r.scale[None, :]
    slack = q.error[:, None] * r.back[None, :] + q.norm[:, None] * r.error[None, :]
    slack = slack * (1 + 1e-9) + np.abs(near) * 1e-12 + (dim + 8) * 2.3e-16 * q.norm[:, None] * r.norm[None, :]
    power = np.broadcast_to(r.power[None, :], near.shape)
    with np.errstate(over="ignore", under="ignore"):
        low, high = np.ldexp(near - slack, power), np.ldexp(near + slack, power)
    both = q.power[:, None] + r.power[None, :]
    unsure = (both > 1020 - math.ceil(math.log2(dim))) | (both < -900) | (power < -900)
    low[unsure], high[unsure] = -np.inf, np.inf
    return low, high


#: A found candidate: 0 if its score is no number (as the largest, like in SQL), the negative score, its id.
Found = tuple[int, float, int]


def merged(q: Tile, r: Tile, k: int, best: list[list[Found]]) -> None:
    """Merge what a tile of candidates holds into each query's ``best``, its k nearest so far in order."""
    low, high = bounds(q, r)
    own = q.ids[:, None] == r.ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    floor = np.partition(low, len(r.ids) - k, axis=1)[:, len(r.ids) - k] if len(r.ids) > k else np.full(len(q.ids), -np.inf)
    for a in range(len(q.ids)):
        least = floor[a]
        if len(best[a]) == k and best[a][-1][0]:
            with np.errstate(over="ignore", under="ignore"):
                least = max(least, np.nextafter(np.ldexp(-best[a][-1][1], -q.power[a]), -np.inf))
        at = np.flatnonzero((high[a] >= least) & ~own[a])
        if not len(at):
            continue
        # From the first component to the last, so that equal vectors give equal sums anywhere.
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            exact = np.add.accumulate(r.rows[at].astype(np.float64) * q.rows[a].astype(np.float64), axis=1)[:, -1]
        number = ~np.isnan(exact)
        new = zip(number.astype(int).tolist(), np.where(number, -exact, 0.0).tolist(), r.ids[at].tolist())
        best[a] = heapq.nsmallest(k, [*best[a], *new])


def _packed(b: pd.DataFrame) -> pd.DataFrame:
    """The rows of one (kind, dim, block) as a tile, in the order of their ids."""
    b = b.sort_values("vec_id")
    t = tile_of(b["vec_id"].to_numpy(np.int64), np.stack(b["embedding"].to_numpy()))
    facts = np.stack([t.power.astype(np.float64), t.scale, t.back, t.norm, t.error])
    key = {c: b[c].iloc[0] for c in ("kind", "dim", "block")}
    return pd.DataFrame([key | {"ids": t.ids.tobytes(), "small": t.small.tobytes(), "facts": facts.tobytes(), "data": t.rows.tobytes()}])


def _tiles(b: pd.DataFrame) -> list[Tile]:
    out = []
    for dim, ids, small, facts, data in zip(b["dim"], b["ids"], b["small"], b["facts"], b["data"]):
        i = np.frombuffer(ids, np.int64)
        f = np.frombuffer(facts, np.float64).reshape(5, -1)
        rows = np.frombuffer(data, np.float32 if len(data) == 4 * len(i) * dim else np.float64).reshape(-1, dim)
        out.append(Tile(i, rows, np.frombuffer(small, np.int8).reshape(-1, dim), f[0].astype(np.int64), *f[1:]))
    return out


def _cell(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        others, rows = _tiles(candidates.sort_values("block")), []
        for q in _tiles(queries.sort_values("block")):
            best: list[list[Found]] = [[] for _ in q.ids]
            for r in others:
                merged(q, r, k, best)
            rows += [(int(i), c, -s if number else math.nan) for i, found in zip(q.ids, best) for number, s, c in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, rows_per_tile: int = 1024, rows_per_cell: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows, nearest first.

    ``is_query`` picks the queries among the rows of ``vectors`` (vec_id,
    embedding); candidates are all rows but those with the query's own id.
    Null, zero or non-finite vectors take no part, and vectors of different
    lengths aren't compared. Ties go to the smaller vec_id. A vec_id that is
    repeated keeps one row, the least vector. Further columns are ignored.

    Tiles of about ``rows_per_tile`` rows stand in a grid of queries by
    candidates; a task works on one cell of it at a time, of about
    ``rows_per_cell`` rows a side at most, whatever the number of rows. What a
    tile holds follows from the ids alone, so that a task that is run again
    makes the same tiles.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    n = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    t_all, t_ask = (max(1, -(-n[c] // rows_per_tile)) for c in ("all", "asking"))
    # As many cells as keep all cores busy, and more where cells would hold too much.
    cells = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n["all"] // rows_per_cell) * -(-n["asking"] // rows_per_cell))
    cols = min(t_all, max(-(-n["all"] // rows_per_cell), math.ceil((cells * t_all / t_ask) ** 0.5), 1))
    lines = min(t_ask, max(-(-n["asking"] // rows_per_cell), -(-cells // cols), 1))
    kinds = rows.select(F.explode(F.when(F.col("asks"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("kind"), "vec_id", "embedding")
    kinds = kinds.withColumn("dim", F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("kind"), t_ask).otherwise(t_all)))
    tiles = kinds.groupBy("kind", "dim", "block").applyInPandas(_packed, TILE)
    # A tile of queries goes to one line of the grid and to all its columns; a tile of candidates to one column and all lines.
    q = tiles.where("kind").withColumn("i", F.pmod("block", F.lit(lines)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    r = tiles.where("NOT kind").withColumn("j", F.pmod("block", F.lit(cols)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    best = q.groupBy("dim", "i", "j").cogroup(r.groupBy("dim", "i", "j")).applyInPandas(_cell(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
