"""Command line: named queries, readers, the pipeline and the audit tools."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import governance as g


def session(args) -> SparkSession:
    return SparkSession.builder.appName("marlstone").getOrCreate()


def _query(args):
    from .plans import registry

    df = registry.QUERIES[args.name](session(args), args.data)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)


#: Inputs of reports, by their readers' names, beside the file of disclosure dates and that of text rules.
INPUTS = ("prices", "statements", "companies", "texts", "universe", "store", "coverage", "listed", "adv", "series", "disclosed", "lexicon")
NUMBERS = ("max_weight", "sector_cap", "max_names", "min_names", "min_adv", "max_participation", "max_notional_fraction", "leg_notional", "min_train", "bps")
FLAGS = ("signals", "non_consolidated", "allow_partial", "elastic")


def _inputs(args):
    from .plans import reports

    number = lambda n: int(getattr(args, n)) if n in ("max_names", "min_names", "min_train") else float(getattr(args, n))
    options = {n: number(n) for n in NUMBERS if getattr(args, n) is not None} | {n: getattr(args, n) for n in FLAGS}
    return reports.Inputs(session(args), {n: getattr(args, n) for n in INPUTS if getattr(args, n)}, (args.dates or "").split(",") if args.dates else [], tuple(int(h) for h in args.horizons.split(",")), options)


def _report(args):
    from .plans import reports

    reports.write(args.command, _inputs(args), args.out)


def _report_all(args):
    from .plans import reports

    reports.consolidated(_inputs(args), args.out)


def _pipeline(args):
    from .plans import pipeline

    x = _inputs(args)
    st = x.table("statements").withColumn("disclosure_date", F.make_date(F.col("fiscal_year"), F.lit(12), F.lit(31)))
    texts = x.table("texts") if "texts" in x.paths else x.spark.createDataFrame([], "ticker string, text string")
    _print(pipeline.run(x.spark, x.table("prices"), st, x.table("companies"), texts, x.decision_dates(), args.out, horizons=x.horizons))


def _prepare(args):
    from .sources import readers, sinks

    spark = session(args)
    df = readers.prices_csv(spark, args.prices)
    if args.universe:
        df = df.join(readers.universe_file(spark, args.universe).select("ticker"), "ticker", "left_semi")
    sinks.price_export(df, args.out, args.field)


def _fetch(args):
    from .sources import ingest, readers, sinks

    spark = session(args)
    new = readers.vendor_bars(readers.vendor_rows_json(spark, args.source))
    universe = readers.universe_file(spark, args.universe).select("ticker")
    store = readers.stored(spark, args.store)
    after = ingest.merged(store.select(*[c for c in store.columns if c in new.columns]), new, universe) if store is not None else new.join(universe, "ticker", "left_semi")
    sinks.bar_store(after.select("ticker", "date", *[c for c in readers.VENDOR_NUMBERS]), args.out)


def _promote(args):
    with open(args.file) as f:
        _print(g.promote(json.load(f), args.ledger, approved=args.approve, note=args.note, required=not args.optional))


def _list(args):
    from .plans import registry

    print("\n".join(sorted(registry.QUERIES)))


def _show(args):
    from .sources import readers

    readers.read(session(args), args.kind, args.path).show(args.rows, truncate=False)


def _print(value):
    print(json.dumps(value, indent=2, sort_keys=True, default=str))


def _determinism(args):
    """Two folders' artifacts; volatile texts are separated by commas."""
    from .operators import determinism as d

    spark = session(args)
    options = {"values": tuple(args.volatile.split(",")), "digits": int(args.digits) if args.digits else None}
    one, two = (d.fingerprints(spark, f, **options) for f in (args.first, args.second))
    found = d.regression(d.compared(one, two), strict=args.strict)
    _print(found)
    return int(found["regression_detected"])


def _baseline(args):
    now = g.tree(args.folder)
    if args.check:
        with open(args.file) as f:
            found = g.compare(json.load(f), now)
        _print(found)
        return int(any(v not in ("unchanged", "volatile_only") for v in found.values()))
    with open(args.file, "w") as f:
        json.dump(now, f, indent=2, sort_keys=True)


REPORT_NAMES = ("analyze", "validate", "readiness", "verify-store", "verify-bars", "daily-features", "coverage-filter", "coverage-excluded", "listed-master", "build-dataset", "dataset-coverage", "ranking", "quantiles", "walk-forward", "train", "score-report", "portfolio", "concentration", "neutralized", "exposures", "linear", "stability", "constraints", "monitoring")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options, **flags):
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(o)
        for o, default in flags.items():
            c.add_argument(f"--{o}", default=default, **({"type": int} if isinstance(default, int) and not isinstance(default, bool) else {"action": "store_true"} if default is False else {}))
        c.set_defaults(run=run)

    add("queries", _list)
    add("query", _query, "name", "data", out=None, rows=20)
    add("read", _show, "kind", "path", rows=20)
    inputs = dict.fromkeys((*INPUTS, "dates", *NUMBERS)) | {"horizons": "5,20,60"} | dict.fromkeys(FLAGS, False)
    for name in REPORT_NAMES:
        add(name, _report, "out", **inputs)
    add("report-all", _report_all, "out", **inputs)
    add("pipeline", _pipeline, "out", **inputs)
    add("prepare-prices", _prepare, "prices", "out", universe=None, field="close")
    add("fetch", _fetch, "source", "universe", "store", "out")
    add("promote", _promote, "file", "ledger", approve=False, optional=False, note="")
    add("history", lambda a: _print(g.summary(g.entries_of(a.path))), "path")
    add("lineage", lambda a: _print(g.lineage(g.entries_of(a.path), a.entry)), "path", "entry")
    add("compare-runs", lambda a: _print(g.compare_folders(a.first, a.second)), "first", "second")
    add("baseline", _baseline, "folder", "file", check=False)
    add("manifest", lambda a: _print(g.manifest(a.folder, {})), "folder")
    add("determinism", _determinism, "first", "second", volatile="", digits=None, strict=False)
    add("ledger-append", lambda a: print(g.append_entry(a.path, json.loads(a.body), approved=a.approve, note=a.note)), "path", "body", approve=False, note="")
    add("ledger-verify", lambda a: _print({"broken_lines": g.broken(g.entries_of(a.path))}), "path")
    add("bundle-export", lambda a: _print(g.export_bundle(a.folder, a.file, {})), "folder", "file")
    add("bundle-verify", lambda a: _print({"wrong": g.verify_bundle(a.file)}), "file")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args) or 0


if __name__ == "__main__":
    sys.exit(main())
