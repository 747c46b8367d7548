"""Functions, kernels, sources and governance on small inputs."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import semantics as s
from marlstone.operators import governance as g
from marlstone.operators import kernels as k
from marlstone.operators import portfolio as pf
from marlstone.sources import ingest, readers


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_semantics(spark):
    n = F.lit(None).cast("double")
    assert one(spark, s.safe_div(F.lit(1.0), F.lit(0.0)), s.pct_change(F.lit(5.0), F.lit(-10.0)), s.yoy(F.lit(5.0), F.lit(-10.0))) == (None, 150.0, -150.0)
    assert one(spark, s.scale(F.lit(5.0), 0, 10), s.scale(n, 0, 10), s.mean_of(F.lit(1.0), n, F.lit(3.0)), s.mean_of(n, n)) == (50.0, None, 2.0, None)
    assert one(spark, *[s.score_bucket(F.lit(x)) for x in (0.0, 99.9, 100.0)], s.score_bucket(n)) == ("0-10", "90-100", "90-100", "none")
    assert one(spark, s.code_padded(F.lit("72030")), s.code_padded(F.lit("72")), s.code_suffixed(F.lit(" 7203.t")), s.code_lettered(F.lit("130A0"))) == ("7203", "0072", "7203", "130A")
    assert one(spark, s.to_number(F.lit("1,234.5")), s.to_number(F.lit("x")), s.to_day(F.lit("2024/01/31")), s.to_day(F.lit("?"))) == (1234.5, None, datetime.date(2024, 1, 31), None)


def test_average_rank_and_corr(spark):
    d = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None)], "i int, x double").withColumn("g", F.lit(1))
    assert [r["r"] for r in d.select("i", s.average_rank("x", "g").alias("r")).orderBy("i").collect()] == [2.5, 1.0, 2.5, None]
    assert d.agg(s.guarded_corr(F.lit(1.0), "x")).first()[0] is None


def test_water_fill_and_residual():
    w, fits = k.water_fill(np.array([0.7, 0.2, 0.1]), 0.5)
    assert fits and abs(w.sum() - 1) < 1e-9 and w.max() <= 0.5 + 1e-12
    assert not k.water_fill(np.array([0.5, 0.5]), 0.3)[1]
    x = np.arange(10.0)[:, None]
    assert np.allclose(np.nan_to_num(k.residual(2 * x[:, 0] + 1, x)), np.full(10, 10.0))


def test_linear_models_find_known_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), float(3 * a - 2 * b + 1)) for a, b in x]
    d = spark.createDataFrame(rows, "a double, b double, y double")
    m = k.ridge(d, ["a", "b"], "y", alpha=1e-9)
    assert abs(m.coef["a"] / m.scale["a"] - 3) < 1e-6 and abs(m.coef["b"] / m.scale["b"] + 2) < 1e-6
    e = k.elastic_net(d, ["a", "b"], "y", alpha=1e-6)
    assert e.status == "ok" and abs(e.coef["a"] - m.coef["a"]) < 1e-3
    assert k.elastic_net(d, ["a", "b"], "y", alpha=1e6).coef == {"a": 0.0, "b": 0.0}
    assert k.ridge(d.limit(1), ["a"], "y").status == "insufficient_rows"


def test_purge_and_monitor(spark):
    d = datetime.date
    t = spark.createDataFrame([(d(2024, 1, 1), d(2024, 1, 10)), (d(2024, 1, 5), d(2024, 2, 5)), (d(2024, 3, 2), d(2024, 3, 9)), (d(2024, 5, 1), d(2024, 5, 9))], "start date, end date")
    got = [r["outcome"] for r in pf.purge_embargo(t, d(2024, 2, 1), d(2024, 2, 28), 10).orderBy("start").collect()]
    assert got == ["kept", "purged", "embargoed", "kept"]


def test_readers(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("﻿ Code ,Trade_Date,Close,Volume\n7203,2024-01-04,\"1,000\",5\n7203,20240105,1010,x\n")
    rows = readers.read(spark, "prices", str(p)).orderBy("date").collect()
    assert [(r["close"], r["volume"]) for r in rows] == [(1000.0, 5.0), (1010.0, None)]
    p.write_text("ticker,date,close\n7203,2024-01-04,\n")
    with pytest.raises(readers.DataError):
        readers.read(spark, "prices", str(p))
    with pytest.raises(readers.SourceError):
        readers.read(spark, "news", "x")
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"Code": "72030", "Date": "2024-01-04", "C": "10", "AdjC": "9"}, {"Code": "72030", "Date": "2024-01-05", "Close": 11}]))
    assert [(r["ticker"], r["close"]) for r in readers.quotes_json(spark, str(q)).orderBy("date").collect()] == [("7203", 10.0), ("7203", 11.0)]
    assert readers.synthetic(spark).count() == 12 * 160


def test_paged_source_and_retry():
    pages = {None: {"rows": [1], "pagination_key": "b"}, "b": {"rows": [2]}}
    assert list(readers.rest_rows(lambda q: pages[q.get("pagination_key")], {}, "rows")) == [1, 2]
    calls, waits = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise readers.SourceError("busy")
        return 7

    assert ingest.with_retry(fetch, wait=1.0, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    day = datetime.date(2024, 1, 10)
    assert ingest.carry_over([datetime.date(2024, 1, 2)], datetime.date(2024, 1, 8), None, day, 5) == [datetime.date(2024, 1, 2), datetime.date(2024, 1, 9), day]


def test_incremental_update(spark):
    d1, d2 = datetime.date(2024, 1, 4), datetime.date(2024, 1, 5)
    uni = spark.createDataFrame([("A",), ("B",)], "ticker string")
    store = spark.createDataFrame([("A", d1, 1.0), ("B", d1, 1.0), ("A", d2, 1.0)], "ticker string, date date, close double")
    due = ingest.due_dates(store, uni, "2024-01-04", "2024-01-07", spark)
    assert due == [d2]
    new = spark.createDataFrame([("A", d2, 2.0), ("B", d2, 2.0), ("C", d2, 2.0)], "ticker string, date date, close double")
    after, log = ingest.update(spark, store, uni, due, lambda d: new)
    assert log["added"] == 1 and {tuple(r) for r in after.collect()} == {("A", d1, 1.0), ("B", d1, 1.0), ("A", d2, 2.0), ("B", d2, 2.0)}
    with pytest.raises(readers.DataError):
        ingest.update(spark, store, uni, due, lambda d: new, stored_field="adj_close")


def test_governance(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "x.json").write_text('{"v": 1, "generated_at": "1"}')
    (b / "x.json").write_text('{"v": 1, "generated_at": "2"}')
    (b / "y.txt").write_text("new")
    assert g.compare(g.tree(str(a)), g.tree(str(b))) == {"x.json": "volatile_only", "y.txt": "new"}
    ledger = str(tmp_path / "l.jsonl")
    g.append_entry(ledger, {"n": 1})
    g.append_entry(ledger, {"n": 2})
    assert g.broken(g.entries_of(ledger)) == []
    with pytest.raises(ValueError):
        g.append_entry(ledger, {"api_key": "zzz"})
    bundle = str(tmp_path / "bundle.json")
    g.export_bundle(str(a), bundle, {})
    assert g.verify_bundle(bundle) == []


def test_pipeline(spark, tmp_path):
    from marlstone.plans import models, pipeline
    from marlstone.sources import views as v

    d = "/root/testdata/sf0.001"
    steps = pipeline.run(spark, v.bars(spark, d), v.statements(spark, d), v.companies(spark, d), v.disclosures(spark, d), v.decision_dates(spark), str(tmp_path), risk_words=models.RISK_WORDS)
    assert len(steps) >= 15 and all(x["status"] == "ok" for x in steps)


@pytest.mark.parametrize("parts", [1, 7])
def test_chain_carries_over_ranges_of_keys(spark, parts):
    keys = [3 * k + k % 2 for k in range(500)]
    d = spark.createDataFrame([(x, f"h{x}") for x in keys], "k long, h string").repartition(5)
    got = [tuple(r) for r in g.chained(d, "k", "h", parts).orderBy("k").select("k", "place", "before").collect()]
    assert got == [(x, n + 1, f"h{keys[n - 1]}" if n else None) for n, x in enumerate(keys)]
    assert g.chained(d.limit(0), "k", "h", parts).count() == 0


def test_ledger_chain_holds_every_order(spark):
    from marlstone.plans import registry

    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    r = registry.QUERIES["ledger_chain_check"](spark, data).agg(F.count("*"), F.max("line"), F.count_if(~F.col("linked"))).first()
    assert tuple(r) == (n, n, n // 40)


def test_tickers_keep_all_digits(spark):
    from marlstone.sources import views as v

    d = spark.createDataFrame([(x,) for x in (7, 1000, 9999, 10000, 10009, 123456)], "k long").orderBy("k")
    assert [r["t"] for r in d.select(v.ticker("k").alias("t")).collect()] == ["0007", "1000", "9999", "10000", "10009", "123456"]


def test_large_keys_are_tickers_of_their_own(spark, tmp_path):
    from marlstone.sources import views as v

    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one = line.where("l_suppkey = 1")
    both = one.unionByName(one.withColumn("l_suppkey", F.lit(10000).cast(line.schema["l_suppkey"].dataType))).unionByName(one.withColumn("l_suppkey", F.lit(1000).cast(line.schema["l_suppkey"].dataType)))
    both.write.parquet(f"{tmp_path}/lineitem.parquet")
    n = {r["ticker"]: (r["n"], r["q"]) for r in v.bars(spark, str(tmp_path)).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("q")).collect()}
    assert set(n) == {"0001", "1000", "10000"} and len(set(n.values())) == 1


def test_complete_dates_ask_for_every_supplier(spark, tmp_path):
    from marlstone.plans import registry

    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1)
    kind = line.schema["l_suppkey"].dataType
    days = {1: "1995-01-01 1995-01-02", 2: "1995-01-01 1995-01-02", 3: "1995-01-01 1995-01-02", 4: "1995-01-02"}
    at = spark.createDataFrame([(k, d) for k, ds in days.items() for d in ds.split()], "k int, d string")
    line.drop("l_suppkey", "l_shipdate").crossJoin(at).withColumns({"l_suppkey": F.col("k").cast(kind), "l_shipdate": F.to_date("d")}).drop("k", "d").write.parquet(f"{tmp_path}/lineitem.parquet")
    at.select(F.col("k").cast(kind).alias("s_suppkey")).distinct().write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["complete_dates"](spark, str(tmp_path)).collect()
    assert [r["date"] for r in got] == [datetime.date(1995, 1, 2)]


def test_readiness_sees_the_latest_disclosures(spark):
    from marlstone.plans import registry
    from marlstone.sources import views as v

    data = "/root/testdata/sf0.001"
    last = v.statements(spark, data).agg(F.max("disclosure_date")).first()[0]
    assert last > datetime.date(2000, 1, 31)
    assert registry.QUERIES["readiness"](spark, data).agg(F.max("disclosure_date")).first()[0] == last


def test_readiness_asks_for_every_statement(spark):
    from marlstone.plans import registry
    from marlstone.sources import views as v

    data = "/root/testdata/sf0.001"
    got = registry.QUERIES["readiness"](spark, data).toPandas()
    asked = {(r["ticker"], r["disclosure_date"]) for r in v.statements(spark, data).select("ticker", "disclosure_date").collect()}
    assert len(got) == 3 * len(asked) and set(zip(got["ticker"], got["disclosure_date"])) == asked
    days = v.bars(spark, data).select("ticker", "date").toPandas()
    for r in got.itertuples():
        n = int(((days["ticker"] == r.ticker) & (days["date"] > r.disclosure_date)).sum())
        assert (r.n_after, r.eligible) == (n, n > r.horizon)
    assert 0 < got["eligible"].sum() < len(got)


def test_readiness_of_disclosures_without_dates_or_prices(spark):
    from marlstone.operators import timeseries as t

    day = datetime.date(2020, 1, 1)
    bars = spark.createDataFrame([("a", day + datetime.timedelta(k)) for k in range(8)], "ticker string, date date")
    told = [("a", day), ("a", day), ("a", day + datetime.timedelta(6)), ("a", None), ("b", day), ("c", None)]
    disclosed = spark.createDataFrame(told, "ticker string, disclosure_date date")
    got = {(r["ticker"], r["disclosure_date"]): (r["n_after"], r["reason"]) for r in t.readiness(bars, disclosed, (5,), every=True).collect()}
    none = "no_disclosure_date"
    assert got == {("a", day): (7, ""), ("a", told[2][1]): (1, "not_enough_rows"), ("a", None): (0, none), ("b", day): (0, "no_prices"), ("c", None): (0, none)}
    latest = {r["ticker"]: (r["disclosure_date"], r["n_after"]) for r in t.readiness(bars, disclosed, (5,)).collect()}
    assert latest == {"a": (told[2][1], 1), "b": (day, 0), "c": (None, 0)}


def test_quotes_of_long_keys_keep_their_tickers(spark, tmp_path):
    """A vendor's code is the ticker and a 0, also where the ticker has five digits or six, or ends in 0 itself."""
    from marlstone.plans import registry

    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey = 1")
    keys = spark.createDataFrame([(x,) for x in (7, 1000, 9999, 10000, 10001, 123450)], "k int")
    line.drop("l_suppkey").crossJoin(keys).withColumnRenamed("k", "l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["dated_source_quotes"](spark, str(tmp_path)).select("ticker", "nested", "date").distinct().collect()
    n = line.select(F.to_date("l_shipdate")).distinct().count()
    per = {}
    for r in got:
        per[(r["ticker"], r["nested"])] = per.get((r["ticker"], r["nested"]), 0) + 1
    assert per == {(t, f"T{t}"): n for t in ("0007", "1000", "9999", "10000", "10001", "123450")}


def test_average_values_do_not_depend_on_the_order_of_bars(spark, tmp_path):
    """Eight values whose mean is a half of the fourth place, dealt to dates in another order for each of eighty tickers."""
    import random

    from marlstone.plans import registry

    rng, rows, want = random.Random(3), [], {}
    for key in range(80):
        if key % 20 == 0:
            cents = [rng.randrange(10**5, 10**8) for _ in range(8)]
            cents[0] += 1 - sum(cents) % 2
        rng.shuffle(cents)
        rows += [(key, datetime.date(1995, 1, 1 + i), x / 100) for i, x in enumerate(cents)]
        # 100 * sum / 8 is a half; it goes up.
        want[f"{key:04d}"] = (100 * sum(cents) + 4) // 8 / 10**4
    line = spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double").withColumns({"l_quantity": F.lit(1.0), "l_discount": F.lit(0.0)})
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["ticker"]: r["adv"] for r in registry.QUERIES["adv_csv_source"](spark, str(tmp_path)).collect()}
    assert got == want
