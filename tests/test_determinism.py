"""Fingerprints of folders: what may differ, what may not, and how rows are dealt."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import determinism as d
from marlstone.operators import governance as g


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def verdicts(spark, a, b, **options):
    found = d.compared(d.fingerprints(spark, str(a), **options), d.fingerprints(spark, str(b), **options))
    return {r["path"]: r["verdict"] for r in found.collect()}, found


def test_files_and_tables(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    one = {"x": 1.0, "deep": [{"generated_at": "now", "k": "é"}]}
    put(a, same__json=json.dumps(one), vol__json=json.dumps(one), chg__json=json.dumps(one), bad__json="{", r__md="# run-1\nx", t__csv="k,v\n1,run-1\n2,b\n", e__txt="", bin__dat="q", gone__txt="x", u__csv="k\n1\n2\n", w__csv="k\n1\n")
    two = {"deep": [{"k": "é", "generated_at": "later"}], "x": 1.0}
    put(b, same__json=json.dumps(one), vol__json=json.dumps(two), chg__json=json.dumps(one | {"x": 2}), bad__json="{", r__md="# run-2\nx", t__csv="k,v\n1,run-2\n2,b\n", e__txt="", bin__dat="p", fresh__txt="x", u__csv="k\n2\n1\n", w__csv="j\n1\n2\n")
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "s").alias("s"), F.array("id").alias("l"))
    df.repartition(5).write.parquet(str(a / "table.parquet"))
    df.orderBy(F.desc("id")).repartition(2).write.parquet(str(b / "table.parquet"))
    df.drop("l").repartition(3).write.partitionBy("v").option("header", True).csv(str(a / "deep" / "parts_csv"))
    df.drop("l").coalesce(1).write.partitionBy("v").option("header", True).csv(str(b / "deep" / "parts_csv"))
    df.repartition(2).write.parquet(str(a / "other.parquet"))
    df.withColumn("s", F.when(F.col("id") == 499, "t").otherwise(F.col("s"))).write.parquet(str(b / "other.parquet"))
    got, found = verdicts(spark, a, b, values=("run-1", "run-2"))
    assert got == {
        "same.json": "unchanged", "vol.json": "volatile_only", "chg.json": "changed", "bad.json": "unreadable", "r.md": "volatile_only", "t.csv": "volatile_only", 
        "bin.dat": "changed", "gone.txt": "missing", "fresh.txt": "new", "u.csv": "changed", "w.csv": "changed", "table.parquet": "unchanged", "deep/parts_csv": "unchanged", "other.parquet": "changed",
    }
    w = found.where("path = 'w.csv'").first()
    assert (w["old_rows"], w["new_rows"], w["fields_differ"]) == (1, 2, True)
    report = d.regression(found)
    assert report["regression_detected"] and "fresh.txt" not in report["regression_artifacts"] and "gone.txt" in report["regression_artifacts"] and report["total"] == 14
    assert "fresh.txt" in d.regression(found, strict=True)["regression_artifacts"]
    assert set(verdicts(spark, a, a)[0].values()) == {"unchanged", "unreadable"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")  # splits of a file change nothing
    try:
        split = d.fingerprints(spark, str(a)).where("kind IN ('csv', 'md')").select("path", "canonical").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(split) == sorted(d.fingerprints(spark, str(a)).where("kind IN ('csv', 'md')").select("path", "canonical").collect())


def test_digits_of_floats(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, x in ((a, 0.1 + 0.2), (b, 0.3)):
        put(folder, n__json=json.dumps({"x": x, "l": [x]}))
        spark.createDataFrame([(x, 0.0), (None, -0.0)], "x double, z double").write.parquet(str(folder / "t.parquet"))
    assert set(verdicts(spark, a, b)[0].values()) == {"changed"}
    assert set(verdicts(spark, a, b, digits=9)[0].values()) == {"volatile_only"}


def test_runs_with_other_partitions_give_the_same(spark, tmp_path):
    from marlstone.plans import models, pipeline
    from marlstone.sources import views as v

    at = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, parts in (("a", "3"), ("b", "7")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            steps = pipeline.run(spark, v.bars(spark, at), v.statements(spark, at), v.companies(spark, at), v.disclosures(spark, at), v.decision_dates(spark), str(tmp_path / name), risk_words=models.RISK_WORDS)
            assert {s["status"] for s in steps} == {"ok"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got, found = verdicts(spark, tmp_path / "a", tmp_path / "b", digits=9, exclude=("manifest.json",))
    assert len(got) > 10 and set(got.values()) <= {"unchanged", "volatile_only"} and not d.regression(found)["regression_detected"]


def test_entry_hashes(spark, tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    for k in range(5):
        g.append_entry(path, {"k": k, "é": [1, {"b": None, "a": "x\"\n"}], "z": True}, note=f"n{k}")
    lines = open(path).read().splitlines()
    lines[2] = lines[2].replace('"note":"n2"', '"note":"n3"')
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*lines, "no json"], 1)], "line long, value string")
    got = {r["line"]: r for r in g.entry_hashes(df).collect()}
    assert [got[k]["sound"] for k in range(1, 7)] == [True, True, False, True, True, False]
    assert got[2]["parent_hash"] == got[1]["entry_hash"] == got[1]["own_hash"]
    with pytest.raises(ValueError):
        open(path, "w").write("\n".join(lines) + "\n")
        g.append_entry(path, {"k": 9})
