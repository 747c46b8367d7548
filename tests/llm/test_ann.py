"""Nearest neighbours of huge, tiny, equal and repeated vectors, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann


def by_hand(vecs, k):
    """Each query's k nearest: NaN first, as SQL orders it, then by score and id."""
    ok = {}
    for i, v in vecs:
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for i, q in ok.items():
        if i % 20:
            continue
        scored = []
        for j, x in ok.items():
            if j != i and len(x) == len(q):
                with np.errstate(all="ignore"):
                    s = float(np.add.accumulate(np.array(q) * np.array(x))[-1])
                scored.append(((0, 0.0) if math.isnan(s) else (1, -s)) + (j, s))
        out[i] = [(j, s) for _, _, j, s in sorted(scored)[:k]]
    return out


def same(a, b):
    return [(i, None if math.isnan(s) else s) for i, s in a] == [(i, None if math.isnan(s) else s) for i, s in b]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_extreme_vectors(spark, kind):
    rng = np.random.default_rng(8)
    big, small = (1e30, 1e-30) if kind == "float" else (1e160, 1e-170)
    rows = [rng.normal(size=2).tolist() for _ in range(60)]
    rows += [[big, big / 2], [big, -big], [-big, big * 3], [small, small], [small * 2, -small], [big, small], [1.0, 0.0]] + [[1.5, 2.5]] * 40
    vecs = [*enumerate(rows)]
    vecs += [(60, [0.5, 0.25]), (60, [0.75, 0.25]), (80, [big / 4, big / 8]), (100, [small, -small]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    vecs = [(i, [float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in vecs]
    d = spark.createDataFrame(vecs, f"vec_id long, embedding array<{kind}>").withColumn("block", F.lit("x"))
    for tile, cell, k in ((8, 16, 5), (1024, 16_384, 20), (8, 8, 200)):
        got = {}
        for r in ann.search(d, F.col("vec_id") % 20 == 0, k=k, rows_per_tile=tile, rows_per_cell=cell).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        want = by_hand(vecs, k)
        assert set(got) == {i for i, w in want.items() if w}
        for i in got:
            assert same(got[i], want[i]), i


def test_large_finite_rows_are_found(spark):
    d = spark.createDataFrame([(0, [1e160, 1e150]), (1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [1e155, 0.0])], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(d, F.col("vec_id") == 0, k=2).orderBy("rank").collect()]
    assert got == [3, 2]
