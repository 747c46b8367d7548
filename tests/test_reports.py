"""Reports and subcommands over a user's own files; stores, ledgers and readers at their edges."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.operators import governance as g
from marlstone.plans import reports
from marlstone.sources import readers, sinks
from marlstone.streaming import upsert


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("in")
    day = [datetime.date(2023, 1, 2) + datetime.timedelta(days=k) for k in range(320) if (datetime.date(2023, 1, 2) + datetime.timedelta(days=k)).weekday() < 5]
    with open(p / "prices.csv", "w") as f:
        f.write("銘柄コード,日付,終値,出来高\n")
        for t in range(1, 13):
            for k, d in enumerate(day):
                f.write(f"{1000 + t},{d:%Y/%m/%d},{100 + t * 3 + (k * (t % 5 + 1)) % 37},{1000 + k}\n")
    with open(p / "statements.csv", "w") as f:
        f.write("code,fy,period,basis,売上高,営業利益,当期純利益,shares,総資産,自己資本\n")
        for t in range(2, 14):
            f.write("".join(f'{1000 + t},{y},FY,consolidated,"{1000 * t + y}",{50 * t},{30 * t + y % 7},100,{3000 * t},{1000 * t}\n' for y in (2021, 2022)))
    with open(p / "companies.csv", "w") as f:
        f.write("code,社名,業種,市場\n" + "".join(f"{1000 + t},Name {t},{'ab'[t % 2]},m\n" for t in range(1, 14)))
    return p


def inputs(spark, files, **options):
    paths = {k: str(files / f"{k}.csv") for k in ("prices", "statements", "companies")}
    return reports.Inputs(spark, paths, ["2023-08-01", "2023-09-01", "2023-10-02"], (5, 20), options)


def test_names_with_bars_or_statements_alone_are_analysed(spark, files):
    got = {r["ticker"]: r for r in reports.analysed(inputs(spark, files, signals=True)).collect()}
    assert set(got) == {str(1000 + t) for t in range(1, 14)}
    assert "no financial statements for ticker" in got["1001"]["warnings"] and got["1001"]["valuation_class"] is None
    assert "no price data for ticker" in got["1013"]["warnings"] and got["1013"]["analysis_date"] == datetime.date(2022, 12, 31)
    assert got["1005"]["n_warnings"] == 0 and got["1005"]["signal"]


@pytest.mark.parametrize("name", ["build-dataset", "ranking", "portfolio", "constraints", "linear", "monitoring", "validate"])
def test_reports_are_written_in_three_forms(spark, files, tmp_path, name):
    x = inputs(spark, files, max_weight=0.6)
    reports.write(name, x, str(tmp_path))
    n = spark.read.option("header", True).csv(f"{tmp_path}/{name}_csv").count()
    md = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/{name}_md").collect())
    assert n > 0 and md.count("\n| ") == n + 1 and md.startswith("# ") and sinks.DISCLAIMER in md
    assert spark.read.json(f"{tmp_path}/{name}_json").count() == n


def test_analysis_subcommand(spark, files, tmp_path):
    assert cli.main(["analyze", str(tmp_path), *(x for k in ("prices", "statements", "companies") for x in (f"--{k}", str(files / f"{k}.csv")))]) == 0
    assert len([d for d in os.listdir(tmp_path / "reports") if d.startswith("ticker=")]) == 13
    with pytest.raises(readers.DataError):
        cli.main(["ranking", str(tmp_path), "--prices", str(files / "prices.csv")])


def test_rows_without_a_price_are_named_by_their_line(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,close\n1,2024-01-04,5\n2,2024-01-04,\n3,soon,7\n")
    with pytest.raises(readers.DataError, match=r"\[2, 3\]"):
        readers.read(spark, "prices", str(tmp_path / "p.csv"))
    (tmp_path / "l.jsonl").write_text('{"entry_hash": "a", "parent_hash": ""}\n{"entry_hash": \n')
    with pytest.raises(readers.DataError, match="line 2"):
        readers.read(spark, "ledger", str(tmp_path / "l.jsonl")).collect()


def test_upsert_survives_a_batch_that_runs_again(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    row = lambda v, d=day: spark.createDataFrame([(1, d, v)], "user_id int, date date, v int")
    path = f"file://{tmp_path}/store"
    put = upsert.upsert_into(path, ["user_id", "date"])
    assert upsert.read_store(spark, path) is None
    put(row(1), 0)
    put(row(2, day + datetime.timedelta(days=1)), 1)
    put(row(3), 2)
    put(row(9), 2)  # done already: nothing changes
    row(7).write.partitionBy("date").parquet(f"{path}/rows/batch=3")  # failed before its marker
    got = {(r["date"], r["v"]) for r in upsert.read_store(spark, path).collect()}
    assert got == {(day, 3), (day + datetime.timedelta(days=1), 2)}
    put(row(8), 3)
    assert upsert.vacuum(spark, path) == 2
    assert {r["v"] for r in upsert.read_store(spark, path).collect()} == {8, 2}


def test_promotion_lineage_and_binary_bundles(tmp_path):
    ledger = str(tmp_path / "l.jsonl")
    with pytest.raises(PermissionError):
        g.promote({"a": 1}, ledger, approved=False, note="x")
    with pytest.raises(ValueError):
        g.promote({"a": 1}, ledger, approved=True, note=" ")
    first, second = (g.promote({"a": k}, ledger, approved=True, note="seen") for k in (1, 2))
    assert g.lineage(g.entries_of(ledger), second) == [second, first] and g.summary(g.entries_of(ledger))["entries"] == 2
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "b.bin").write_bytes(bytes(range(256)))
    (folder / "r.json").write_text(json.dumps({"ic": 0.5, "elapsed_seconds": 3}))
    g.export_bundle(str(folder), str(tmp_path / "b.json"), {})
    assert g.verify_bundle(str(tmp_path / "b.json")) == []
    other = tmp_path / "g"
    other.mkdir()
    (other / "r.json").write_text(json.dumps({"ic": 0.25, "elapsed_seconds": 9}))
    found = g.compare_folders(str(folder), str(other))
    assert [(d["metric"], d["delta"]) for d in found["numbers"]] == [("r.json.ic", -0.25)]


def test_overall_ranks_share_ties(spark):
    from marlstone.functions.semantics import ranked_overall

    d = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, None, 2.0, 3.0)], "x double")
    assert sorted((r["x"] or 0.0, r["k"]) for r in ranked_overall(d, "x", "k").where("x IS NOT NULL").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
    assert ranked_overall(d, "x", "k").where("x IS NULL").first()["k"] is None
