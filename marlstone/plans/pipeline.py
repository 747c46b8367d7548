"""The modeling pipeline: recorded steps from inputs to an audited folder of reports."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as g
from ..operators import kernels as k
from ..operators import modeling as m
from ..operators import portfolio as pf
from ..sources import sinks
from ..sources.scratch import written


def run(spark: SparkSession, bars: DataFrame, statements: DataFrame, companies: DataFrame, texts: DataFrame, dates: DataFrame, out: str, *, risk_words: list[str] = (), horizons=(5, 20, 60), exposures=("momentum_60d", "leverage"), bps: float = 10.0) -> list[dict]:
    """Write reports below ``out`` and return the steps' records. Reports are of a row per date, bucket or factor."""
    os.makedirs(out, exist_ok=True)
    steps: list[dict] = []
    label = f"forward_return_h{horizons[1] if len(horizons) > 1 else horizons[0]}"

    def step(name, make):
        began = time.time()
        try:
            value, status = make(), "ok"
            rows = [r.asDict() for r in value.collect()] if isinstance(value, DataFrame) else None
        except Exception as err:  # noqa: BLE001 - a step that fails is recorded, and the others go on
            value, rows, status = None, None, f"failed: {type(err).__name__}: {str(err).splitlines()[0][:200] if str(err) else ''}"
        if rows is not None:
            sinks.json_file({"name": name, "rows": rows}, os.path.join(out, f"{name}.json"))
        elif value is not None:
            sinks.json_file({"name": name, "value": value}, os.path.join(out, f"{name}.json"))
        steps.append({"step": name, "status": status, "rows": None if rows is None else len(rows), "elapsed_seconds": round(time.time() - began, 3)})
        return value

    ds = m.excess_returns(m.dataset(bars, statements, companies, texts, dates, list(risk_words), horizons), horizons)
    # Tables are written where executors share a folder; ``out``, the driver's, gets reports alone.
    ds, _ = written(ds)
    step("coverage", lambda: ds.groupBy("decision_date", "exclusion").agg(F.count("*").alias("n"), F.count(label).alias("labelled")).orderBy("decision_date", "exclusion"))
    d = ds.where("exclusion = ''")
    s = m.baseline_scores(d).join(d.select("decision_date", "ticker", "sector", *exposures, *[f"forward_return_h{h}" for h in horizons]), ["decision_date", "ticker"])
    s, _ = written(s)
    for h in horizons:
        step(f"ranking_h{h}", lambda h=h: m.ic_summary(m.rank_ic(s, f"forward_return_h{h}")))
        step(f"quantiles_h{h}", lambda h=h: m.quantile_table(s, f"forward_return_h{h}").orderBy("bucket"))
    spreads = pf.date_spreads(s, label)
    pos = pf.positions(s, label)
    step("spreads", lambda: spreads.orderBy("decision_date"))
    step("spread_summary", lambda: pf.spread_summary(spreads))
    step("net", lambda: pf.net_of_cost(spreads, pf.turnover(pos), bps).orderBy("decision_date"))
    step("concentration", lambda: pf.concentration(pos).orderBy("decision_date", "leg"))
    step("neutral_ranking", lambda: k.neutral_rank_ic(s, list(exposures), label).orderBy("decision_date"))
    step("exposures", lambda: k.exposure_diagnostics(s, list(exposures)))
    model = step("elastic_net", lambda: k.elastic_net(d, ["earnings_yield", "book_to_market", "roe", "momentum_60d", "volatility"], label).coef)
    step("stability", lambda: pf.stability(m.rank_ic(s, label).select(F.lit("rank_ic").alias("metric"), F.col("ic").alias("value"))))
    step("monitoring", lambda: pf.monitor(m.rank_ic(s, label).select(F.lit("rank_ic").alias("metric"), F.col("decision_date").alias("date"), F.col("ic").alias("value"))).orderBy("metric", "date"))
    sinks.json_file({"steps": [{x: v for x, v in r.items() if x != "elapsed_seconds"} for r in steps], "model": model}, os.path.join(out, "pipeline.json"))
    sinks.json_file(g.manifest(out, {"horizons": list(horizons), "exposures": list(exposures), "bps": bps}), os.path.join(out, "manifest.json"))
    return steps
