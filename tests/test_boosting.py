"""Boosted trees against a grower that makes every pair and tries every split."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import boosting as b

FEATURES = ["f0", "f1", "f2"]
U = b.UNIT


def table(spark, seed, n=90, dates=3, parts=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.choice([None, float("nan"), 0.0, 1.5, rng.gauss(0, 1)]) if rng.random() < 0.3 else round(rng.gauss(0, 1), 2) for _ in FEATURES]
        y = None if k % 17 == 0 else sum(v for v in x if v is not None and v == v) + rng.gauss(0, 0.3)
        rows.append((f"d{k % dates}" if k else "lonely", k, *x, y))
    return spark.createDataFrame(rows, "decision_date string, k int, f0 double, f1 double, f2 double, y double").repartition(parts)


def pair_gradients(rows, s):
    """g and h of each row from all pairs of its date."""
    g, h = [0] * len(rows), [0] * len(rows)
    by_date = {}
    for i, r in enumerate(rows):
        by_date.setdefault(r["decision_date"], []).append(i)
    for idx in by_date.values():
        pairs = [(i, j) for i in idx for j in idx if rows[i]["relevance"] > rows[j]["relevance"]]
        for i, j in pairs:  # half of (1 - (s_i - s_j)) squared
            d = s[i] - s[j] - U
            g[i] += d
            g[j] -= d
            h[i] += 1
            h[j] += 1
        w = len(idx) / len(pairs) if pairs else 0.0
        for i in idx:
            g[i], h[i] = half_up(g[i] * w), half_up(h[i] * w * U)
    return g, h


def half_up(x):
    import decimal

    return int(decimal.Decimal(x).quantize(decimal.Decimal(1), decimal.ROUND_HALF_UP))


def grow(rows, bins, gradients, trees, depth, rate, smooth, least):
    s = [0] * len(rows)
    for _ in range(trees):
        g, h = gradients(s)
        leaves, split = {1: list(range(len(rows)))}, False
        for _ in range(depth):
            after = {}
            for node, idx in leaves.items():
                best = None
                for f, t in itertools.product(range(len(FEATURES)), range(40)):
                    left = [i for i in idx if bins[i][f] <= t]
                    right = [i for i in idx if bins[i][f] > t]
                    if len(left) < least or len(right) < least or not any(bins[i][f] == t for i in left):
                        continue
                    q = lambda part: b.score(sum(g[i] for i in part), sum(h[i] for i in part), smooth)
                    gain = q(left) + q(right) - q(idx)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, left, right)
                if best is None:
                    after[node] = idx
                else:
                    split = True
                    after[2 * node], after[2 * node + 1] = best[1], best[2]
            leaves = after
        for idx in leaves.values():
            v = b.leaf(sum(g[i] for i in idx), sum(h[i] for i in idx), smooth, rate)
            for i in idx:
                s[i] += v
        if not split:
            break
    return [x / U for x in s]


@pytest.mark.parametrize("ranking", [True, False])
def test_scores_are_those_of_the_plain_grower(spark, ranking):
    rows = b.relevance(table(spark, 3), "y")
    options = dict(trees=5, depth=3, rate=0.3, smooth=1.0, least=4)
    model = b.fit(rows, FEATURES, "relevance" if ranking else "y", ranking=ranking, bins=8, cut=2, **options)
    got = model.predict(rows).withColumn("bins", model.bins()).collect()
    bins = [list(r["bins"]) for r in got]
    gradients = (lambda s: pair_gradients(got, s)) if ranking else (lambda s: ([a - half_up(r["y"] * U) for a, r in zip(s, got)], [U] * len(got)))
    assert [r["score"] for r in got] == grow(got, bins, gradients, **options)
    assert all(r["bins"][j] == (0 if r[f] is None or r[f] != r[f] else 1 + sum(e < r[f] for e in model.edges[j])) for r in got for j, f in enumerate(FEATURES))
    assert {x for r in bins for x in r} <= set(range(9)) and all(r["bins"][0] == 0 for r in got if r["f0"] is None or r["f0"] != r["f0"])
    assert sum(v for _, v in model.importance()) == pytest.approx(1.0)
    # How rows are dealt makes no difference.
    again = b.fit(b.relevance(table(spark, 3, parts=7), "y"), FEATURES, "relevance" if ranking else "y", ranking=ranking, bins=8, cut=3, **options)
    assert again.trees == model.trees


def test_relevance_is_the_bucket_of_mean_ranks(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 2, 5, 6, 7, 8, 9, 10)] + [("b", 1.0), ("b", None)], "decision_date string, y double")
    got = [(r["decision_date"], r["y"], r["relevance"]) for r in b.relevance(d, "y").orderBy("decision_date", "y").collect()]
    assert got == [("a", 1.0, 0), ("a", 2.0, 1), ("a", 2.0, 1), ("a", 2.0, 1), ("a", 5.0, 2), ("a", 6.0, 2), ("a", 7.0, 3), ("a", 8.0, 3), ("a", 9.0, 4), ("a", 10.0, 4), ("b", 1.0, 0)]


def test_outcomes(spark):
    from marlstone.operators.modeling import FACTORS

    kinds = ", ".join(f"{f} double" for f in FACTORS)
    schema = f"decision_date date, ticker string, sector string, {kinds}, forward_return_h20 double"
    none = spark.createDataFrame([], schema)
    r = b.train(none, "lightgbm_ranker")
    assert (r.status, r.missing, r.scored) == (b.MISSING, "lightgbm", None)
    assert b.train(none, b.RANKER).status == b.TOO_FEW
    with pytest.raises(ValueError):
        b.train(none, "other")
    rng = random.Random(1)
    import datetime

    rows = [(datetime.date(2024, 1 + k % 4, 1), str(k), None, *[rng.gauss(0, 1) if j else float(k % 50) for j in range(len(FACTORS))], float(k % 50)) for k in range(400)]
    r = b.train(spark.createDataFrame(rows, schema), b.RANKER, trees=4, rate=0.5)
    assert r.status == b.TRAINED and r.model.importance()[0][0] == FACTORS[0]
    assert r.scored.agg(F.corr("score", "forward_return_h20")).first()[0] > 0.9
    flat = b.train(spark.createDataFrame([(x[0], x[1], None, *[1.0] * len(FACTORS), x[-1]) for x in rows], schema), b.REGRESSOR)
    assert flat.status == b.TRAINED and not flat.model.trees[0].splits and all(v == 0.0 for _, v in flat.model.importance())
