"""Fingerprints, determinism, baselines, hash-chained ledgers and audit bundles."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of key names whose values are secret, and keys whose values may differ between runs.
SECRET = ("token", "secret", "password", "api_key", "apikey", "authorization", "credential")
VOLATILE = ("generated_at", "created_at_utc", "started_at_utc", "finished_at_utc", "elapsed_seconds", "absolute_path", "run_directory", "output_dir")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def digest(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def scrubbed(value: object) -> object:
    """Without values of secret keys, and with local paths cut."""
    if isinstance(value, dict):
        return {k: "[removed]" if any(s in str(k).lower() for s in SECRET) else scrubbed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [scrubbed(v) for v in value]
    return re.sub(r"(/[A-Za-z0-9._-]+){2,}", "[path]", value) if isinstance(value, str) else value


def masked(value: object, keys: tuple[str, ...] = VOLATILE) -> object:
    if isinstance(value, dict):
        return {k: "[volatile]" if k in keys else masked(v, keys) for k, v in value.items()}
    return [masked(v, keys) for v in value] if isinstance(value, list) else value


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, raw_sha256 of all files below a folder, read by the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/")
    return f.select(F.expr(f"substring_index(path, '{root}/', -1)").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("raw_sha256"))


def file_fingerprint(path: str) -> dict:
    """Raw and canonical digest of a file; JSON is canonical without volatile values."""
    with open(path, "rb") as f:
        data = f.read()
    out = {"size": len(data), "raw_sha256": digest(data), "canonical_sha256": digest(data)}
    if path.endswith(".json"):
        try:
            out["canonical_sha256"] = digest(canonical(masked(json.loads(data))))
        except ValueError:
            out["canonical_sha256"] = None
    return out


def tree(folder: str) -> dict[str, dict]:
    return {os.path.relpath(os.path.join(d, n), folder): file_fingerprint(os.path.join(d, n)) for d, _, names in sorted(os.walk(folder)) for n in sorted(names)}


def compare(old: dict[str, dict], new: dict[str, dict]) -> dict[str, str]:
    """Per path: unchanged, volatile_only, changed, missing, new or unreadable."""
    out = {}
    for p in sorted(old.keys() | new.keys()):
        a, b = old.get(p), new.get(p)
        if a is None or b is None:
            out[p] = "new" if a is None else "missing"
        elif b["canonical_sha256"] is None:
            out[p] = "unreadable"
        elif a["raw_sha256"] == b["raw_sha256"]:
            out[p] = "unchanged"
        else:
            out[p] = "volatile_only" if a["canonical_sha256"] == b["canonical_sha256"] else "changed"
    return out


def manifest(folder: str, config: dict) -> dict:
    """An audit manifest; its run id is the digest of its body."""
    body = {"config": scrubbed(config), "artifacts": tree(folder)}
    return {"run_id": digest(canonical(body))[:16], **body}


def append_entry(path: str, body: dict, *, approved: bool = True, note: str = "") -> str:
    """Append to a hash-chained ledger after checking it; unsafe content or a broken chain is refused."""
    if not approved:
        raise PermissionError("not approved")
    entries = entries_of(path)
    if broken(entries):
        raise ValueError("the ledger's chain is broken")
    if scrubbed(body) != body:
        raise ValueError("the entry holds secrets or local paths")
    parent = entries[-1]["entry_hash"] if entries else ""
    content = {"body": body, "note": note, "parent_hash": parent}
    entry = content | {"entry_hash": digest(canonical(content))}
    with open(path, "a") as f:
        f.write(canonical(entry) + "\n")
    return entry["entry_hash"]


def entries_of(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [json.loads(line) for line in f if line.strip()]


def broken(entries: list[dict]) -> list[int]:
    """Lines, from 1, whose hash or parent is wrong."""
    out, parent = [], ""
    for k, e in enumerate(entries, 1):
        body = {x: v for x, v in e.items() if x != "entry_hash"}
        if e.get("parent_hash") != parent or e.get("entry_hash") != digest(canonical(body)):
            out.append(k)
        parent = e.get("entry_hash")
    return out


def chained(df: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds ``place``, the rows' numbers from 1 in the order of the unique number ``key``, and ``before``, the value of the row before.

    No task orders all rows: ranges of keys are numbered apart, and a row per
    range, its size and last value, carries numbers and values over to the next.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Any cuts give the same result; these give ranges of about the same size.
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    over = F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: F.col(key).cast("double") > c)
    df = df.withColumn("__range", F.size(over))
    # A row per range.
    ends = sorted((r["__range"], r["n"], r["last"]) for r in df.groupBy("__range").agg(F.count("*").alias("n"), F.max_by(value, key).alias("last")).collect())
    rows, n, last = [], 0, None
    for k, size, end in ends:
        rows.append((k, n, last))
        n, last = n + size, end
    carried = spark.createDataFrame(rows, f"__range int, __offset long, __last {df.schema[value].dataType.simpleString()}")
    w = Window.partitionBy("__range").orderBy(key)
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__lag", F.lag(value).over(w)).join(F.broadcast(carried), "__range")
    return df.withColumn("place", F.col("__n") + F.col("__offset")).withColumn("before", F.when(F.col("__n") == 1, F.col("__last")).otherwise(F.col("__lag"))).drop("__range", "__n", "__lag", "__offset", "__last")


def chain_links(ledger: DataFrame) -> DataFrame:
    """Adds ``linked``: an entry's parent is the entry before; the first has none."""
    return chained(ledger, "line", "entry_hash").withColumn("linked", F.col("parent_hash") == F.coalesce("before", F.lit(""))).drop("place", "before")


def entry_hashes(lines: DataFrame) -> DataFrame:
    """line, entry_hash, parent_hash, own_hash, sound of a ledger's lines (line, value: an entry's JSON).

    own_hash is the digest of the entry's canonical form without entry_hash,
    as append_entry() takes it; ``sound``: it is the entry's. A line that is
    no JSON has neither.
    """
    v = lines.select("line", F.try_parse_json("value").alias("v"))
    rest = F.to_variant_object(F.map_filter(F.col("v").cast("map<string,variant>"), lambda k, _: k != "entry_hash"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    out = v.select("line", text("entry_hash").alias("entry_hash"), text("parent_hash").alias("parent_hash"), F.sha2(F.to_json(rest), 256).alias("own_hash"))
    return out.withColumn("sound", F.coalesce(F.col("entry_hash") == F.col("own_hash"), F.lit(False)))


def summary(entries: list[dict]) -> dict:
    """Number of entries, broken lines, and the last entry's hash and note."""
    last = entries[-1] if entries else {}
    return {"entries": len(entries), "broken_lines": broken(entries), "last_hash": last.get("entry_hash"), "last_note": last.get("note")}


def lineage(entries: list[dict], entry: str) -> list[str]:
    """Hashes from an entry back to the first one, by parents."""
    by_hash, out = {e["entry_hash"]: e for e in entries}, []
    while entry in by_hash and entry not in out:
        out.append(entry)
        entry = by_hash[entry].get("parent_hash") or ""
    return out


def promote(baseline: dict, ledger: str, *, approved: bool, note: str, required: bool = True) -> str:
    """Append a baseline's digest to a ledger that is whole; where approval is required also a reviewer's note is."""
    if required and not approved:
        raise PermissionError("promotion needs approval")
    if required and not note.strip():
        raise ValueError("promotion needs a reviewer's note")
    return append_entry(ledger, {"baseline_sha256": digest(canonical(masked(baseline))), "files": len(baseline)}, approved=approved or not required, note=note)


def compare_folders(first: str, second: str) -> dict:
    """What differs between two runs' folders: files by their digests, and numbers of their JSON files."""
    def numbers(folder: str) -> dict[str, float]:
        out: dict[str, float] = {}

        def walk(value, at):
            if isinstance(value, bool):
                return
            if isinstance(value, (int, float)):
                out[at] = float(value)
            elif isinstance(value, dict):
                for k, v in value.items():
                    walk(v, f"{at}.{k}")
            elif isinstance(value, list):
                for k, v in enumerate(value):
                    walk(v, f"{at}[{k}]")

        for root, _, files in os.walk(folder):
            for name in sorted(files):
                if name.endswith(".json"):
                    path = os.path.join(root, name)
                    with open(path) as f:
                        walk(masked(json.load(f)), os.path.relpath(path, folder))
        return out

    deltas = [d for d in compare_runs(numbers(first), numbers(second)) if d["direction"] != "equal"]
    return {"files": compare(tree(first), tree(second)), "numbers": deltas}


def compare_runs(a: dict[str, float], b: dict[str, float]) -> list[dict]:
    """Neutral deltas of two runs' numbers."""
    out = []
    for k in sorted(a.keys() | b.keys()):
        x, y = a.get(k), b.get(k)
        way = "added" if x is None else "removed" if y is None else "higher" if y > x else "lower" if y < x else "equal"
        out.append({"metric": k, "a": x, "b": y, "delta": None if x is None or y is None else y - x, "direction": way})
    return out


def export_bundle(folder: str, out: str, config: dict) -> dict:
    """A single JSON file with a folder's manifest and files: texts as they are, others as base64."""
    files = {}
    for p in tree(folder):
        with open(os.path.join(folder, p), "rb") as f:
            data = f.read()
        try:
            files[p] = data.decode()
        except UnicodeDecodeError:
            files[p] = {"base64": base64.b64encode(data).decode()}
    bundle = {"manifest": manifest(folder, config), "files": files}
    bundle["bundle_sha256"] = digest(canonical(bundle))
    with open(out, "w") as f:
        json.dump(bundle, f, sort_keys=True)
    return bundle["manifest"]


def verify_bundle(path: str) -> list[str]:
    """What is wrong with a bundle; nothing if it is whole."""
    with open(path) as f:
        b = json.load(f)
    found = [] if digest(canonical({k: v for k, v in b.items() if k != "bundle_sha256"})) == b.get("bundle_sha256") else ["bundle digest"]
    for p, held in b.get("files", {}).items():
        data = base64.b64decode(held["base64"]) if isinstance(held, dict) else held
        if b["manifest"]["artifacts"].get(p, {}).get("raw_sha256") != digest(data):
            found.append(p)
    return found
