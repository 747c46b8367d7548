"""Reports over a user's own inputs: what each needs, how it is made, and in which order its rows stand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as a
from ..operators import kernels as k
from ..operators import modeling as m
from ..operators import portfolio as pf
from ..operators import quality as q
from ..operators import timeseries as t
from ..sources import readers, sinks
from ..sources.scratch import written

MODEL_FACTORS = ["earnings_yield", "book_to_market", "roe", "momentum_60d", "volatility"]


@dataclass
class Inputs:
    """Tables by name, and the dataset and scores made from them when first asked for."""

    spark: SparkSession
    paths: dict[str, str]
    dates: list[str] = field(default_factory=list)
    horizons: tuple[int, ...] = (5, 20, 60)
    options: dict[str, object] = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, kind: str) -> DataFrame:
        if kind not in self.made:
            if kind not in self.paths:
                raise readers.DataError(f"this report needs --{kind}")
            self.made[kind] = readers.read(self.spark, kind, self.paths[kind])
        return self.made[kind]

    @property
    def label(self) -> str:
        return f"forward_return_h{self.horizons[1] if len(self.horizons) > 1 else self.horizons[0]}"

    def decision_dates(self) -> DataFrame:
        if not self.dates:
            raise readers.DataError("this report needs --dates")
        return self.spark.createDataFrame([(d,) for d in self.dates], "d string").select(F.to_date("d").alias("decision_date"))

    def dataset(self) -> DataFrame:
        if "dataset" not in self.made:
            st = self.table("statements")
            known = self.paths.get("disclosed")  # ticker, date of disclosure; without it everything is known by its year's end
            if known:
                d = readers.disclosed_csv(self.spark, known)
                st = st.join(d, "ticker", "left")
            else:
                st = st.withColumn("disclosure_date", F.make_date(F.col("fiscal_year"), F.lit(12), F.lit(31)))
            texts = self.table("texts") if "texts" in self.paths else self.spark.createDataFrame([], "ticker string, text string")
            made = m.dataset(self.table("prices"), st, self.table("companies"), texts, self.decision_dates(), [], self.horizons, include_non_consolidated=bool(self.options.get("non_consolidated")))
            self.made["dataset"] = written(m.excess_returns(written(made)[0], self.horizons))[0]
        return self.made["dataset"]

    def included(self) -> DataFrame:
        return self.dataset().where("exclusion = ''")

    def scored(self) -> DataFrame:
        if "scored" not in self.made:
            d = self.included()
            labels = [f"forward_return_h{h}" for h in self.horizons]
            self.made["scored"] = written(m.baseline_scores(d).join(d.select("decision_date", "ticker", "sector", "momentum_60d", "leverage", *labels), ["decision_date", "ticker"]))[0]
        return self.made["scored"]

    def positions(self) -> DataFrame:
        return pf.positions(self.scored(), self.label)


def analysed(x: Inputs) -> DataFrame:
    """A row for each ticker that has bars or statements, with scores, rank and what is missing as warnings."""
    mom, st = t.momentum(x.table("prices")), x.table("statements")
    years = st.groupBy("ticker").agg(F.max("fiscal_year").alias("__year"), F.lit(True).alias("__stated"))
    d = a.valuation(a.fundamentals(st), mom).join(mom, "ticker", "full_outer").join(years, "ticker", "left").join(x.table("companies"), "ticker", "left")
    lexicon = x.paths.get("lexicon")
    if lexicon and "texts" in x.paths:
        rules = x.spark.read.option("header", True).schema("rule_id string, category string, keyword string, severity string, confidence double, tone_weight double").csv(lexicon)
        d = d.join(a.tone(x.table("texts"), rules), "ticker", "left")
    else:
        d = d.join(a.no_findings(d.select("ticker")), "ticker", "left")
    priced = F.col("analysis_date").isNotNull()
    said = [
        F.when(~priced, "no price data for ticker"),
        F.when(F.col("__stated").isNull(), "no financial statements for ticker"),
        F.when(~priced | F.col("__stated").isNull(), "valuation skipped: needs both a statement and a market price"),
        F.when(F.col("disclosure_confidence").isNull(), "no disclosure text for ticker"),
        F.when(~priced & F.col("__year").isNotNull(), "analysis date approximated from fiscal year (no price data)"),
        F.when(~priced & F.col("__year").isNull(), "analysis date set to today (no dated inputs)"),
    ]
    d = d.withColumn("warnings", F.filter(F.array(*said), lambda w: w.isNotNull())).withColumn("n_warnings", F.size("warnings"))
    d = d.withColumn("analysis_date", F.coalesce("analysis_date", F.make_date(F.col("__year"), F.lit(12), F.lit(31)), F.current_date())).drop("__year", "__stated")
    d = a.screening(a.sector_relative(a.reliability(a.scores(a.risk_flags(d)))))
    return a.signals(d) if x.options.get("signals") else d


def _evaluated(x: Inputs) -> DataFrame:
    """One row per horizon of the rank correlations."""
    rows = [m.ic_summary(m.rank_ic(x.scored(), f"forward_return_h{h}")).withColumn("horizon", F.lit(h)) for h in x.horizons]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("horizon", "n_dates", "ic_mean", "ic_std", "icir", "sector_neutral_ic_mean")


def _coefficients(x: Inputs, fit) -> DataFrame:
    model = fit(x.included(), MODEL_FACTORS, x.label)
    return x.spark.createDataFrame([(f, float(c), dict(model.importance()).get(f, 0.0), model.status) for f, c in model.coef.items()] or [(None, None, None, model.status)], "feature string, coefficient double, importance double, status string")


def _constrained(x: Inputs) -> DataFrame:
    p = x.positions()
    if "adv" in x.paths:
        p = p.join(x.table("adv"), "ticker", "left")
    named = ("max_weight", "sector_cap", "max_names", "min_names", "min_adv", "max_participation", "max_notional_fraction", "leg_notional")
    return k.constrain(p, **{n: x.options[n] for n in named if x.options.get(n) is not None})


def _folds(x: Inputs) -> DataFrame:
    folds = pf.walk_forward(x.spark, x.scored().select("decision_date"), min_train=int(x.options.get("min_train") or 2)).where("role = 'test'").select("fold", "decision_date")
    return m.rank_ic(x.scored(), x.label).join(folds, "decision_date").select("fold", "decision_date", "n", "ic")


def _series(x: Inputs) -> DataFrame:
    return x.table("series") if "series" in x.paths else m.rank_ic(x.scored(), x.label).select(F.lit("rank_ic").alias("metric"), F.col("decision_date").alias("date"), F.col("ic").alias("value"))


@dataclass
class Report:
    make: Callable[[Inputs], DataFrame]
    order: list[str]
    title: str


REPORTS: dict[str, Report] = {
    "analyze": Report(analysed, ["rank"], "Screening"),
    "validate": Report(lambda x: t.forward_returns(x.table("prices"), x.decision_dates(), x.horizons), ["decision_date", "ticker"], "Forward returns"),
    "readiness": Report(lambda x: t.readiness(x.table("prices"), readers.disclosed_csv(x.spark, x.paths["disclosed"]), x.horizons), ["ticker", "horizon"], "Readiness"),
    "verify-store": Report(lambda x: q.store_check(x.table("prices"), x.table("universe")), ["n_rows"], "Store"),
    "verify-bars": Report(lambda x: q.bar_quality(x.table("store")), ["n_rows"], "Bar quality"),
    "daily-features": Report(lambda x: t.date_ranks(t.daily_features(x.table("store")), {"turnover_rank_by_date": "turnover_value", "volume_rank_by_date": "volume", "liquidity_rank_by_date": "avg_turnover_20d"}), ["ticker", "date"], "Daily features"),
    "coverage-filter": Report(lambda x: q.usable(x.table("coverage"), bool(x.options.get("allow_partial"))), ["ticker"], "Usable tickers"),
    "coverage-excluded": Report(lambda x: x.table("coverage").join(q.usable(x.table("coverage"), bool(x.options.get("allow_partial"))), "ticker", "left_anti"), ["ticker"], "Excluded tickers"),
    "listed-master": Report(lambda x: readers.listed_match(x.table("universe"), x.table("listed")), ["ticker"], "Listed master"),
    "build-dataset": Report(lambda x: x.dataset(), ["decision_date", "ticker"], "Dataset"),
    "dataset-coverage": Report(lambda x: x.dataset().groupBy("decision_date", "exclusion").agg(F.count("*").alias("n"), F.count(x.label).alias("labelled")), ["decision_date", "exclusion"], "Dataset coverage"),
    "ranking": Report(_evaluated, ["horizon"], "Ranking"),
    "quantiles": Report(lambda x: m.quantile_table(x.scored(), x.label), ["bucket"], "Quantiles"),
    "walk-forward": Report(_folds, ["fold", "decision_date"], "Walk-forward"),
    "train": Report(lambda x: x.scored(), ["decision_date", "ticker"], "Baseline scores"),
    "score-report": Report(lambda x: m.score_distribution(x.scored()), ["decision_date"], "Scores"),
    "portfolio": Report(lambda x: pf.net_of_cost(pf.date_spreads(x.scored(), x.label), pf.turnover(x.positions()), float(x.options.get("bps") or 10.0)), ["decision_date"], "Portfolio"),
    "concentration": Report(lambda x: pf.concentration(x.positions()), ["decision_date", "leg"], "Concentration"),
    "neutralized": Report(lambda x: k.neutral_rank_ic(x.scored(), ["momentum_60d", "leverage"], x.label), ["decision_date"], "Neutralised ranking"),
    "exposures": Report(lambda x: k.exposure_diagnostics(x.scored(), ["momentum_60d", "leverage"]), ["exposure"], "Exposures"),
    "linear": Report(lambda x: _coefficients(x, k.elastic_net if x.options.get("elastic") else k.ridge), ["feature"], "Linear model"),
    "stability": Report(lambda x: pf.stability(_series(x).select("metric", "value")), ["metric"], "Stability"),
    "constraints": Report(_constrained, ["decision_date", "leg", "ticker"], "Constrained portfolio"),
    "monitoring": Report(lambda x: pf.monitor(_series(x)), ["metric", "date"], "Monitoring"),
}


def write(name: str, x: Inputs, out: str) -> None:
    """Make a report and write it below ``out``; the analysis also gives a file per ticker."""
    r = REPORTS[name]
    df, _ = written(r.make(x))
    sinks.report(df, out, name, r.order, r.title)
    if name == "analyze":
        sinks.ticker_reports(df, f"{out}/reports")


def consolidated(x: Inputs, out: str, names=("dataset-coverage", "ranking", "quantiles", "score-report", "portfolio", "concentration", "neutralized", "exposures", "stability", "monitoring")) -> None:
    """Several reports from one dataset, each with its files, and a list of them."""
    for n in names:
        write(n, x, out)
    x.spark.createDataFrame([(n, REPORTS[n].title) for n in names], "report string, title string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/index_csv")
