"""Ordered sinks of several files, their manifests, and reading in order."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources import readers, sinks
from marlstone.sources.readers import DataError


def lines(path):
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [open(os.path.join(path, f)).read().splitlines() for f in files]


def test_files_hold_ranges_of_the_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.format_string("v%d", "id").alias("v")).repartition(7)
    path = str(tmp_path / "csv")
    got = sinks.ordered(df, path, ["k"], "csv", rows=300, header=True)
    want = json.load(open(os.path.join(path, sinks.MANIFEST)))
    assert want["files"] == got and want["rows"] == 1000 == sum(f["rows"] for f in got) and 3 <= len(got) <= 4
    keys = [int(x.split(",")[0]) for part in lines(path) for x in part[1:]]
    assert keys == list(range(1000))
    back = readers.ordered_rows(spark, path, "k int, v string").orderBy("line").collect()
    assert [(r["line"], r["k"]) for r in back] == [(k + 1, k) for k in range(1000)]
    os.remove(os.path.join(path, got[1]["file"]))
    with pytest.raises(DataError, match=got[1]["file"]):
        readers.ordered_rows(spark, path, "k int, v string")


def test_reports_of_several_files(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else float(k), "x|y") for k in range(10)], "rank int, score double, ticker string")
    sinks.markdown_table(df, str(tmp_path / "md"), ["rank"], "Title", rows=4)
    parts = lines(tmp_path / "md")
    flat = [x for p in parts for x in p]
    assert len(parts) > 1 and flat[:4] == ["# Title", "", "| rank | score | ticker |", "|---|---|---|"] and flat[-1] == sinks.DISCLAIMER and flat[4].startswith("| 0 | 0.0000 |") and flat[5] == "| 1 |  | x|y |" and len(flat) == 16
    sinks.json_report(df, str(tmp_path / "json"), ["rank"], rows=4)
    rows = [json.loads(x) for p in lines(tmp_path / "json") for x in p]
    assert [r["rank"] for r in rows] == list(range(10)) and "score" not in rows[1] and "__value" not in rows[0]
    sinks.ranked_csv(df.withColumn("label", F.lit(None).cast("string")), str(tmp_path / "rank"), ["rank"], rows=4)
    assert all(p[0] == "rank,score,ticker" for p in lines(tmp_path / "rank"))


def test_an_empty_table_gives_one_file(spark, tmp_path):
    df = spark.createDataFrame([], "k int, v string")
    sinks.ordered(df, str(tmp_path / "e"), ["k"], "csv", header=True)
    assert readers.ordered_rows(spark, str(tmp_path / "e"), "k int, v string").count() == 0
