"""Whether two runs gave the same: fingerprints of a folder's artifacts, taken by executors, and their comparison.

An artifact is a file, or a folder of part files, which is a table: how its
rows are dealt over files, and in which order, makes no difference, since rows
are folded into counts and sums of hashes. Files of text keep their order.
What may differ between runs is masked before: values of volatile keys in
JSON, at any depth, and volatile texts (a run's id, a time, a folder) in text
and CSV.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .governance import VOLATILE, canonical, digest, masked

#: Ends of files' names that are compared as text, line by line.
TEXT = ("md", "csv", "txt", "jsonl")
FIELDS = "path string, kind string, rows long, fields string, raw string, canonical string"


def _exact(v: Column, kind: str, digits: int | None) -> Column:
    """A value as text; floats with so many significant digits, if that is set, since sums depend on their order."""
    if digits is not None and kind in ("double", "float"):
        return F.when(v == 0, F.lit("0")).otherwise(F.format_string(f"%.{digits - 1}e", v.cast("double")))
    return v.cast("string")


def _sums(value: Column) -> Column:
    """A digest of a group's values, as an aggregate, whatever their order."""
    a, b = (F.sum(F.xxhash64(F.lit(k), value).cast("decimal(38,0)")) for k in (1, 2))
    return F.sha2(F.concat_ws(":", F.count("*"), a, b), 256)


def table_fingerprint(df: DataFrame, digits: int | None = None) -> tuple[int, str, str]:
    """Number of rows, columns, and a digest of the rows that doesn't depend on their order, or on how they are dealt."""
    kinds = sorted(df.dtypes)
    one = lambda c, k: F.to_json(F.struct(f"`{c}`")) if k.startswith(("array", "struct", "map")) else _exact(F.col(f"`{c}`"), k, digits)
    value = F.concat_ws("\x1f", *[F.coalesce(one(c, k), F.lit("\0")) for c, k in kinds])
    found = df.agg(F.count("*").alias("rows"), _sums(value).alias("sum")).first()
    return found["rows"], ",".join(f"{c}:{k}" for c, k in kinds), found["sum"]


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, file, at of every file below a folder: ``path`` is the artifact's, relative to the folder; hidden files, markers and empty files are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("at"))
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.expr(f"substring_index(file, '{root}/', -1)")
    name = F.element_at(F.split("file", "/"), -1)
    part = name.startswith("part-")
    # Folders that hold a part's column belong to the table above them.
    table = F.regexp_replace(F.regexp_replace(rel, r"/?part-[^/]*$", ""), r"(/[^/=]+=[^/]*)+$", "")
    form = F.when(name.contains(".parquet"), "parquet").when(name.contains(".csv"), "csv").otherwise("text")
    kind = F.when(part, F.concat(F.lit("table:"), form)).otherwise(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return files.where(~name.rlike(r"^[._]")).select(F.when(part, table).otherwise(rel).alias("path"), kind.alias("kind"), "file", "at")


def _json_rows(keys: tuple[str, ...], digits: int | None):
    def rounded(v):
        if isinstance(v, float) and digits is not None:
            return float(f"{v:.{digits - 1}e}")
        if isinstance(v, dict):
            return {k: rounded(x) for k, x in v.items()}
        return [rounded(x) for x in v] if isinstance(v, list) else v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["value"]):
                try:
                    v = json.loads(text)
                    out.append((path, "json", 1, ",".join(sorted(v)) if isinstance(v, dict) else "", digest(text), digest(canonical(rounded(masked(v, keys))))))
                except ValueError:
                    out.append((path, "json", 1, "", digest(text), None))
            yield pd.DataFrame(out, columns=["path", "kind", "rows", "fields", "raw", "canonical"])

    return run


def fingerprints(spark: SparkSession, folder: str, *, keys: tuple[str, ...] = VOLATILE, values: tuple[str, ...] = (), exclude: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """path, kind, rows, fields, raw, canonical of every artifact; canonical is NULL where a JSON file is none.

    ``digits``: floats of tables and JSON count with so many significant
    digits alone. A table's raw and canonical digests are alike but for that.
    Files are read by executors, those of text in splits; the driver has a
    row for each artifact.
    """
    listed = artifacts(spark, folder)
    listed = listed.where(~F.col("path").isin(*exclude)) if exclude else listed
    is_table = F.col("kind").startswith("table:")
    root = folder.rstrip("/")
    out: list[tuple] = []
    for r in listed.where(is_table).select("path", "kind").distinct().collect():
        form = r["kind"].removeprefix("table:")
        df = spark.read.option("header", form == "csv").format(form).load(f"{root}/{r['path']}" if r["path"] else root)
        rows, fields, raw = table_fingerprint(df)
        out.append((r["path"], r["kind"], rows, fields, raw, raw if digits is None else table_fingerprint(df, digits)[2]))
    frames = [spark.createDataFrame(out, FIELDS)]
    alone = listed.where(~is_table).collect()  # a row for each file that is an artifact by itself
    names = F.broadcast(spark.createDataFrame([(r["path"], r["kind"], r["at"]) for r in alone], "path string, kind string, at string"))

    def read(kinds: Callable[[str], bool], form: str, **options) -> DataFrame | None:
        files = [r["file"] for r in alone if kinds(r["kind"])]
        if not files:
            return None
        place = {"at": F.col("_metadata.file_path"), "part": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()}
        rows = spark.read.format(form).options(**options).load(files).withColumns(place)
        return rows.select("at", "part", "row", "content" if form == "binaryFile" else "value").join(names, "at")

    whole = read(lambda k: k == "json", "text", wholetext=True)
    if whole is not None:
        frames.append(whole.select("path", "value").mapInPandas(_json_rows(keys, digits), FIELDS))
    text = read(lambda k: k in TEXT, "text")
    if text is not None:
        frames.append(_lines(text, names, values))
    other = read(lambda k: k != "json" and k not in TEXT, "binaryFile")
    if other is not None:
        raw = F.sha2("content", 256)
        frames.append(other.select("path", "kind", F.lit(1).cast("long").alias("rows"), F.lit("").alias("fields"), raw.alias("raw"), raw.alias("canonical")))
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result


def _lines(text: DataFrame, names: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Fingerprints of files of text, from path, kind, value, part (a split's place in its file) and row: lines are hashed with their numbers."""
    # A row for each split of a file.
    parts = text.groupBy("path", "part").agg(F.min("row").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = text.join(F.broadcast(parts.withColumn("before", before)), ["path", "part"]).withColumn("line", F.col("before") + F.col("row") - F.col("low"))
    clean = F.col("value")
    for v in sorted({v for v in values if v}, key=len, reverse=True):
        clean = F.replace(clean, F.lit(v), F.lit("[volatile]"))
    numbered = lambda x: F.concat_ws("\x1f", F.col("line"), x)
    d = d.select("path", F.when(F.col("line") == 0, F.col("value")).alias("head"), numbered(F.col("value")).alias("v"), numbered(clean).alias("c"))
    one = d.groupBy("path").agg(F.count("*").alias("rows"), F.max("head").alias("head"), _sums(F.col("v")).alias("raw"), _sums(F.col("c")).alias("canonical"))
    every = names.where(F.col("kind").isin(*TEXT)).join(one, "path")
    is_csv, rows = F.col("kind") == "csv", F.col("rows")
    return every.select("path", "kind", F.when(is_csv, F.greatest(rows - 1, F.lit(0))).otherwise(rows).alias("rows"), F.when(is_csv, F.coalesce("head", F.lit(""))).otherwise("").alias("fields"), "raw", "canonical")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, verdict and what differs: unchanged, volatile_only, changed, missing, new or unreadable; of changed ones rows and fields of both."""
    o = old.select("path", *[F.col(c).alias(f"old_{c}") for c in ("rows", "fields", "raw", "canonical")])
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in ("rows", "fields", "raw", "canonical")])
    j = o.join(n, "path", "full")
    verdict = (
        F.when(F.col("old_raw").isNull(), "new")
        .when(F.col("new_raw").isNull(), "missing")
        .when(F.col("old_canonical").isNull() | F.col("new_canonical").isNull(), "unreadable")
        .when(F.col("old_canonical") != F.col("new_canonical"), "changed")
        .when(F.col("old_raw") != F.col("new_raw"), "volatile_only")
        .otherwise("unchanged")
    )
    return j.select("path", verdict.alias("verdict"), "old_rows", "new_rows", (~F.col("old_fields").eqNullSafe(F.col("new_fields"))).alias("fields_differ"))


def regression(found: DataFrame, *, strict: bool = False) -> dict:
    """How many artifacts have each verdict, and which are regressions: changed or missing ones, and new ones if ``strict``."""
    rows = found.select("path", "verdict").collect()  # a row for each artifact
    bad = {"changed", "missing"} | ({"new"} if strict else set())
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["verdict"]] = counts.get(r["verdict"], 0) + 1
    named = sorted(r["path"] for r in rows if r["verdict"] in bad)
    return {"total": len(rows), "counts": dict(sorted(counts.items())), "regression_detected": bool(named), "regression_artifacts": named}
