"""Ranks within keys against counting, with ties, frequent values, missing ones and null keys."""

import random

import pytest

from marlstone.functions.ranks import ranks_within


def table(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        key = rng.choice(["a", "a", "a", "b", None])
        v = rng.choice([None, 7.0, 7.0, 7.0, float(rng.randint(0, 9)), rng.gauss(5, 3), -0.0, 0.0])
        rows.append((k, key, v, float(k % 3)))
    rows.append((600, "c", 1.0, 1.0))
    rows.append((601, "d", None, None))
    return rows, spark.createDataFrame(rows, "k int, key string, v double, __r double").withColumnRenamed("__r", "u")


def counted(rows, at, ascending, method):
    out = {}
    for r in rows:
        if r[at] is None:
            out[r[0]] = None
            continue
        mine = [x[at] for x in rows if x[1] == r[1] and x[at] is not None]
        less = sum((x < r[at]) if ascending else (x > r[at]) for x in mine)
        ties = sum(x == r[at] for x in mine)
        out[r[0]] = less + 1 if method == "min" else less + (ties + 1) / 2
    return out


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("method", ["average", "min"])
def test_ranks_are_those_of_counting(spark, ascending, method):
    rows, d = table(spark, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = ranks_within(d, ["key"], {"rv": "v", "ru": "u"}, ascending=ascending, method=method).collect()
            assert {r["k"]: r["rv"] for r in got} == counted(rows, 2, ascending, method)
            assert {r["k"]: r["ru"] for r in got} == counted(rows, 3, ascending, method)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_tables_and_columns(spark):
    rows, d = table(spark, 6)
    assert ranks_within(d.limit(0), ["key"], {"r": "v"}).count() == 0
    assert ranks_within(d, ["key"], {"r": "v"}).columns == [*d.columns, "r"]
    with pytest.raises(ValueError):
        ranks_within(d, ["key"], {"r": "v"}, method="dense")


@pytest.mark.parametrize("method", ["average", "min"])
def test_ranges_of_large_keys(spark, monkeypatch, method):
    """Keys above the size of a range, with their counts sent to each task or joined."""
    from marlstone.functions import ranks

    rows, d = table(spark, 7)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40, raising=False)
    for sent in (10**6, 0):
        monkeypatch.setattr(ranks, "SENT", sent, raising=False)
        for ascending in (True, False):
            got = ranks_within(d, ["key"], {"rv": "v", "ru": "u"}, ascending=ascending, method=method).collect()
            assert {r["k"]: r["rv"] for r in got} == counted(rows, 2, ascending, method)
            assert {r["k"]: r["ru"] for r in got} == counted(rows, 3, ascending, method)


def test_rank_may_take_the_place_of_its_value(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 3.0)], "key int, v double")
    got = ranks_within(d, ["key"], {"v": "v", "w": "v"}, method="min")
    assert got.columns == ["key", "v", "w"] and sorted(tuple(r) for r in got.collect()) == [(1, 1, 1), (1, 2, 2)]


def moved(df):
    return str(df._jdf.queryExecution().optimizedPlan()), str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_ranks_move_rows_of_many_small_keys_once(spark):
    d = spark.range(400).selectExpr("id % 100 AS key", "rand(1) AS a", "rand(2) AS b", "rand(3) AS c")
    plan, n = moved(ranks_within(d, ["key"], {"ra": "a", "rb": "b", "rc": "c"}, method="min"))
    assert n == 1 and "Join" not in plan


def test_liquidity_ranks_write_and_move_only_what_is_ranked(spark, monkeypatch):
    from marlstone.functions import ranks
    from marlstone.plans import registry

    seen = []
    monkeypatch.setattr(ranks, "written", lambda df, real=ranks.written: (seen.append(df), real(df))[1])
    got = registry.QUERIES["liquidity_ranks"](spark, "/root/testdata/sf0.001")
    assert len(seen[0].columns) == 5 and moved(seen[0])[1] <= 1 and moved(got)[1] == 1
