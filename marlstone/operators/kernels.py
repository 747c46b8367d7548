"""Small numeric kernels: neutralisation, linear rankers, importance, capped weights.

What grows with the data is reduced in Spark: a Gram matrix of the factors, or
one date's cross-section per task. The rest is linear algebra on a few dozen
numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranks_within
from ..functions.semantics import average_rank, guarded_corr


def residual(y: np.ndarray, x: np.ndarray, proportion: float = 1.0) -> np.ndarray:
    """y less ``proportion`` of its least-squares fit on x with an intercept; missing y stay missing, missing x take the column's mean."""
    out = np.full(len(y), np.nan)
    known = ~np.isnan(y)
    if known.sum() < 2:
        out[known] = y[known]
        return out
    cols = []
    for k in range(x.shape[1]):
        c = x[known, k]
        if np.isnan(c).all():
            continue
        c = np.where(np.isnan(c), np.nanmean(c), c)
        if np.ptp(c) > 1e-12:
            cols.append(c)
    design = np.column_stack([np.ones(known.sum()), *cols])
    beta = np.linalg.lstsq(design, y[known], rcond=None)[0]
    fit = design @ beta
    out[known] = y[known] - proportion * (fit - fit.mean())
    return out


def neutralise(scored: DataFrame, exposures: list[str], *, by: str = "decision_date", proportion: float = 1.0) -> DataFrame:
    """Adds ``neutral``: the score less its part explained by the exposures, within each date.

    A missing exposure takes its mean over the date's known scores; one that
    is constant there, or missing throughout, explains nothing. The normal
    equations of a date come from one aggregation of its rows and are solved
    per date; what is spread over the tasks are a date's coefficients, a row
    for each date.
    """
    known = scored.where(F.col("score").isNotNull())
    means = known.groupBy(by).agg(F.count("*").alias("__n"), F.avg("score").alias("__my"), *[F.avg(e).alias(f"__m{i}") for i, e in enumerate(exposures)])
    x = {i: F.coalesce(F.col(e).cast("double") - F.col(f"__m{i}"), F.lit(0.0)) for i, e in enumerate(exposures)}
    rows = known.join(F.broadcast(means), by)  # a row for each date
    y = F.col("score") - F.col("__my")
    n = len(exposures)
    sums = rows.groupBy(by).agg(F.array(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(n)]).alias("g"), F.array(*[F.sum(x[i] * y) for i in range(n)]).alias("v"), F.array(*[F.max(x[i]) - F.min(x[i]) for i in range(n)]).alias("spread"), F.first("__n").alias("n"))

    def solve(batches):
        for b in batches:
            out = []
            for g, v, spread, rows in zip(b["g"], b["v"], b["spread"], b["n"]):
                g, v = np.array(g, float).reshape(n, n), np.array(v, float)
                use = np.array(spread, float) > 1e-12
                beta = np.zeros(n)
                if rows >= 2 and use.any():
                    scale = np.sqrt(np.diag(g)[use])
                    beta[use] = np.linalg.lstsq(g[np.ix_(use, use)] / np.outer(scale, scale), v[use] / scale, rcond=1e-10)[0] / scale
                out.append(beta.tolist())
            yield pd.DataFrame({by: b[by], "__beta": out})

    kind = scored.schema[by].dataType.simpleString()
    beta = sums.mapInPandas(solve, f"`{by}` {kind}, __beta array<double>")
    facts = F.broadcast(means.join(beta, by))
    fit = sum((x[i] * F.col("__beta")[i] for i in range(n)), F.lit(0.0))
    neutral = F.when(F.col("score").isNotNull(), F.col("score") - proportion * F.when(F.col("__n") >= 2, fit).otherwise(0.0))
    return scored.join(facts, by, "left").withColumn("neutral", neutral).select(*scored.columns, "neutral")


def neutral_rank_ic(scored: DataFrame, exposures: list[str], label: str) -> DataFrame:
    """decision_date, n, raw_ic, neutral_ic."""
    n = neutralise(scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()), exposures)
    n = n.withColumn("neutral", F.round("neutral", 9))
    n = ranks_within(n.select("decision_date", "score", "neutral", label), ["decision_date"], {"r_s": "score", "r_n": "neutral", "r_y": label})
    return n.groupBy("decision_date").agg(F.count("*").alias("n"), guarded_corr("r_s", "r_y").alias("raw_ic"), guarded_corr("r_n", "r_y").alias("neutral_ic"))


def exposure_diagnostics(scored: DataFrame, exposures: list[str]) -> DataFrame:
    """exposure, before, after: pooled correlations of score and neutral score with each exposure."""
    n = neutralise(scored.where(F.col("score").isNotNull()), exposures)
    one = n.agg(*[guarded_corr("score", e).alias(f"b_{e}") for e in exposures], *[guarded_corr("neutral", e).alias(f"a_{e}") for e in exposures])
    return one.select(F.expr(f"stack({len(exposures)}, " + ", ".join(f"'{e}', b_{e}, a_{e}" for e in exposures) + ") AS (exposure, before, after)"))


def sector_columns(df: DataFrame, sectors: list[str]) -> DataFrame:
    """Adds a 0/1 column for each sector, in the order of names."""
    return df.withColumns({f"sector_{s}": F.coalesce((F.col("sector") == s).cast("double"), F.lit(0.0)) for s in sorted(sectors)})


@dataclass
class Linear:
    features: list[str]
    status: str
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    coef: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    history: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = F.lit(self.intercept)
        for f in self.features:
            if self.coef.get(f):
                out = out + (F.coalesce(F.col(f), F.lit(self.median[f])) - self.mean[f]) / self.scale[f] * self.coef[f]
        return df.withColumn(name, out)

    def importance(self) -> list[tuple[str, float]]:
        """Shares of absolute scaled coefficients, largest first."""
        total = sum(abs(v) for v in self.coef.values())
        return sorted(((f, abs(v) / total if total else 0.0) for f, v in self.coef.items()), key=lambda p: (-p[1], p[0]))


def gram(df: DataFrame, features: list[str], label: str) -> tuple[Linear, np.ndarray, np.ndarray, int]:
    """Medians, means and deviations, and the standardised Gram matrix, from two aggregations over all rows."""
    rows = df.where(F.col(label).isNotNull())
    med = rows.agg(*[F.median(f).alias(f) for f in features]).first()
    m = Linear(features, "ok", {f: float(med[f]) if med[f] is not None else 0.0 for f in features})
    x = {f: F.coalesce(F.col(f), F.lit(m.median[f])).cast("double") for f in features}
    y = F.col(label).cast("double")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    s = rows.agg(F.count("*").alias("n"), F.avg(y).alias("y"), *[F.avg(x[f]).alias(f"m_{f}") for f in features], *[F.covar_pop(x[a], x[b]).alias(f"c_{a}_{b}") for a, b in pairs], *[F.covar_pop(x[f], y).alias(f"y_{f}") for f in features]).first()
    n = s["n"]
    if n < 2:
        m.status = "insufficient_rows"
        return m, np.zeros((0, 0)), np.zeros(0), n
    m.intercept = float(s["y"])
    m.mean = {f: float(s[f"m_{f}"]) for f in features}
    sd = {f: float(np.sqrt(max(0.0, s[f"c_{f}_{f}"]))) for f in features}
    m.scale = {f: sd[f] if sd[f] > 1e-12 else 1.0 for f in features}
    g = np.zeros((len(features), len(features)))
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        g[i, j] = g[j, i] = s[f"c_{a}_{b}"] / (m.scale[a] * m.scale[b])
    v = np.array([s[f"y_{f}"] / m.scale[f] for f in features])
    flat = np.array([sd[f] <= 1e-12 for f in features])
    g[flat] = g[:, flat] = v[flat] = 0
    return m, g, v, n


def ridge(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> Linear:
    """Coefficients of (X'X + alpha I) b = X'y on standardised factors; constant factors get zero."""
    m, g, v, n = gram(df, features, label)
    if m.status == "ok":
        a = n * g + alpha * np.eye(len(features))
        try:
            b = np.linalg.solve(a, n * v)
        except np.linalg.LinAlgError:
            b = np.linalg.pinv(a) @ (n * v)
        m.coef = dict(zip(features, b.tolist()))
    return m


def elastic_net(df: DataFrame, features: list[str], label: str, alpha: float = 0.05, l1: float = 0.5, max_iter: int = 1000, tol: float = 1e-8) -> Linear:
    """Coordinate descent in covariance form for RSS / 2n + alpha l1 |b| + alpha (1 - l1) b^2 / 2."""
    m, g, v, n = gram(df, features, label)
    if m.status != "ok":
        return m
    b = np.zeros(len(features))
    for _ in range(max_iter):
        largest = 0.0
        for k in range(len(b)):
            if g[k, k] <= 0:
                continue
            rho = v[k] - g[k] @ b + g[k, k] * b[k]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (g[k, k] + alpha * (1 - l1))
            largest = max(largest, abs(new - b[k]))
            b[k] = new
        m.history.append(largest)
        if largest < tol:
            break
    else:
        m.status = "not_converged"
    m.coef = dict(zip(features, b.tolist()))
    return m


def permutation_importance(df: DataFrame, model: Linear, label: str, seed: int = 7) -> DataFrame:
    """feature, importance: mean rank IC less that with the feature's values dealt anew within each date.

    Within a date the k-th row by a seeded hash gets the value of the k-th row
    by ticker. All features are dealt in one pass: a row stands once for each
    feature, and once as it is.
    """
    rows = df.where(F.col(label).isNotNull())
    used = [f for f in model.features if model.coef.get(f)]
    out = "feature string, importance double"
    if not used:
        return df.sparkSession.createDataFrame([], out)
    rows = rows.select("decision_date", "ticker", F.col(label).alias("__y"), *model.features)
    every = rows.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(f) for f in used])))
    w = Window.partitionBy("feature", "decision_date")
    value = F.lit(None).cast("double")
    for f in used:
        value = F.when(F.col("feature") == f, F.col(f).cast("double")).otherwise(value)
    every = every.withColumn("__i", F.row_number().over(w.orderBy("ticker"))).withColumn("__k", F.row_number().over(w.orderBy(F.xxhash64("decision_date", "ticker", "feature", F.lit(seed)), "ticker"))).withColumn("__v", value)
    dealt = every.select("feature", "decision_date", F.col("__i").alias("__k"), F.col("__v").alias("__new"))
    every = every.join(dealt, ["feature", "decision_date", "__k"])
    every = every.withColumns({f: F.when(F.col("feature") == f, F.col("__new")).otherwise(F.col(f).cast("double")) for f in used})
    p = model.predict(every).withColumn("score", F.round("score", 9))
    p = p.withColumn("r_s", average_rank("score", "feature", "decision_date")).withColumn("r_y", average_rank("__y", "feature", "decision_date"))
    ic = p.groupBy("feature", "decision_date").agg(guarded_corr("r_s", "r_y").alias("ic")).groupBy("feature").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"))
    base = ic.where("feature = ''").select(F.col("ic").alias("base"))
    # One row: the IC of the values as they are.
    return ic.where("feature <> ''").crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("ic")).alias("importance"))


def water_fill(weights: np.ndarray, cap: float) -> tuple[np.ndarray, bool]:
    """Weights held below ``cap``; what is cut off is dealt to the others by their room below it; False if there is too little room."""
    w = weights.astype(float)
    over = w > cap + 1e-12
    excess, room = (w[over] - cap).sum(), np.where(over, 0.0, np.maximum(cap - w, 0.0))
    share = min(1.0, excess / room.sum()) if room.sum() > 1e-12 else 0.0
    out = np.where(over, cap, w + share * room)
    return out, bool(out.sum() >= w.sum() - 1e-9)


LEG = ["decision_date", "leg"]


def constrain(
    positions: DataFrame, *, max_weight: float | None = None, sector_cap: float | None = None, max_names: int | None = None, min_names: int | None = None,
    min_adv: float | None = None, max_participation: float | None = None, max_notional_fraction: float | None = None, leg_notional: float = 1.0,
    allow_without_adv: bool = False, prior: DataFrame | None = None, max_turnover: float | None = None,
) -> DataFrame:
    """positions with constrained (its weight, 0 for a name left out), status and reason of its date.

    In this order within each leg: names whose adv (0 if unknown) is below
    ``min_adv`` go; fewer than ``min_names`` names, or none left, make the
    leg's weights 0 and the date infeasible; the ``max_names`` largest stay,
    by weight, then ticker, and get the leg's sum again; weights are held
    below ``max_weight`` and the caps by adv, and what is cut off is dealt to
    the others by their room; sectors above ``sector_cap`` are scaled to it.
    With ``prior`` (decision_date, ticker, weight, signed) the book of a date
    moves toward it until its one-sided turnover is ``max_turnover`` at most;
    names of the prior book alone then follow as rows. A date whose weights
    add up to less than before is feasible_reduced. Caps by adv without a
    column adv leave the weights as they are and say liquidity_data_missing,
    unless ``allow_without_adv`` has them skipped.
    """
    by_adv = any(x is not None for x in (min_adv, max_participation, max_notional_fraction))
    have_adv = "adv" in positions.columns
    if by_adv and not have_adv and not allow_without_adv:
        return positions.withColumn("constrained", F.col("weight")).withColumn("status", F.lit("liquidity_data_missing")).withColumn("reason", F.lit(None).cast("string"))
    by_adv = by_adv and have_adv
    adv = F.coalesce(F.col("adv"), F.lit(0.0)) if by_adv else F.lit(0.0)
    leg = Window.partitionBy(*LEG)
    p = positions.withColumn("__in", adv >= min_adv if by_adv and min_adv is not None else F.lit(True))
    p = p.withColumn("__n", F.count_if("__in").over(leg)).withColumn("__gross", F.sum("weight").over(leg))
    few = F.when((F.col("__n") == 0) & F.lit(by_adv and min_adv is not None), "all_names_fail_liquidity")
    if min_names is not None:
        few = few.when(F.col("__n") < min_names, "too_few_names")
    p = p.withColumn("__few", few.otherwise(F.lit(None).cast("string")))
    if max_names is not None:
        place = F.row_number().over(leg.orderBy(F.desc("__in"), F.desc("weight"), "ticker"))
        p = p.withColumn("__in", F.col("__in") & (place <= max_names))
    p = p.withColumn("__w", F.when(F.col("__in") & F.col("__few").isNull(), F.col("weight")).otherwise(0.0))
    total = F.sum("__w").over(leg)
    p = p.withColumn("__w", F.when(total > 0, F.col("__w") / F.when(total > 0, total) * F.col("__gross")).otherwise(F.col("__w")))
    caps = [F.lit(float(max_weight))] if max_weight is not None else []
    if by_adv and leg_notional > 0:
        caps += [adv * x / leg_notional for x in (max_participation, max_notional_fraction) if x is not None]
    if caps:
        cap = F.least(*caps) if len(caps) > 1 else caps[0]
        over = F.col("__w") > F.col("__cap") + 1e-12
        p = p.withColumn("__cap", F.when(F.col("__in"), cap).otherwise(0.0))
        p = p.withColumn("__excess", F.sum(F.when(over, F.col("__w") - F.col("__cap")).otherwise(0.0)).over(leg))
        p = p.withColumn("__room", F.when(over, 0.0).otherwise(F.greatest(F.col("__cap") - F.col("__w"), F.lit(0.0))))
        rooms = F.sum("__room").over(leg)
        share = F.when(rooms > 1e-12, F.least(F.lit(1.0), F.col("__excess") / F.when(rooms > 1e-12, rooms))).otherwise(0.0)
        p = p.withColumn("__share", share).withColumn("__w", F.when(over, F.col("__cap")).otherwise(F.col("__w") + F.col("__share") * F.col("__room"))).drop("__cap", "__excess", "__room", "__share")
    if sector_cap is not None:
        part = F.sum("__w").over(Window.partitionBy(*LEG, F.coalesce(F.nullif("sector", F.lit("")), F.lit("unknown"))))
        p = p.withColumn("__w", F.when(part > sector_cap + 1e-12, F.col("__w") * sector_cap / F.when(part > 0, part)).otherwise(F.col("__w")))
    date = Window.partitionBy("decision_date")
    p = p.withColumn("reason", F.coalesce(F.max(F.when(F.col("leg") == "long", F.col("__few"))).over(date), F.max("__few").over(date)))
    if prior is not None and max_turnover is not None:
        p = _toward(p, prior, max_turnover)
    p = p.withColumn("__less", (F.sum("__w").over(leg) < F.col("__gross") - 1e-9).cast("int"))
    status = F.when(F.col("reason").isNotNull(), "infeasible").when(F.max("__less").over(date) == 1, "feasible_reduced").otherwise("ok")
    return p.withColumn("status", status).select(*positions.columns, F.col("__w").alias("constrained"), "status", "reason")


def _toward(p: DataFrame, prior: DataFrame, max_turnover: float) -> DataFrame:
    """The weights of feasible dates moved toward the prior, signed book, so that turnover is ``max_turnover`` at most."""
    sign = F.when(F.col("leg") == "long", 1.0).otherwise(-1.0)
    keys = ["decision_date", "ticker"]
    book = p.groupBy(*keys).agg(F.sum(sign * F.col("__w")).alias("__t"), F.first("reason").alias("__reason"))
    was = prior.groupBy(*keys).agg(F.sum("weight").alias("__p"))
    both = book.join(was, keys, "full_outer").fillna(0.0, ["__t", "__p"])
    turn = F.sum(F.abs(F.col("__t") - F.col("__p"))).over(Window.partitionBy("decision_date")) / 2
    share = F.when(turn > max_turnover + 1e-12, F.lit(max_turnover) / F.when(turn > 0, turn)).otherwise(1.0)
    moved = both.withColumn("__b", F.col("__p") + share * (F.col("__t") - F.col("__p"))).withColumn("__scaled", share < 1.0)
    moved = moved.withColumn("leg", F.when(F.col("__b") > 0, "long").otherwise("short")).select(*keys, "leg", "__b", "__scaled")
    state = p.groupBy(*LEG).agg(F.first("__gross").alias("__g"), F.first("reason").alias("__r"))
    scaled = moved.where("__scaled AND abs(__b) > 1e-12").drop("__scaled").join(p.select("decision_date").where("reason IS NULL").distinct(), "decision_date", "left_semi")
    done = scaled.select("decision_date").distinct()
    same = p.join(done, "decision_date", "left_anti")
    old = p.join(done, "decision_date", "left_semi").drop("__w", "__gross", "reason")
    new = old.join(scaled, [*keys, "leg"], "full_outer").join(state, LEG, "left")
    new = new.withColumn("__w", F.coalesce(F.abs("__b"), F.lit(0.0))).withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("__gross", F.coalesce("__g", F.lit(0.0))).withColumn("reason", F.col("__r"))
    return same.unionByName(new.select(*same.columns))


def toward_prior(target: DataFrame, prior: DataFrame, max_turnover: float) -> DataFrame:
    """ticker, weight: a signed book moved from the prior one toward the target by as much turnover as allowed."""
    j = target.select("ticker", F.col("weight").alias("t")).join(prior.select("ticker", F.col("weight").alias("p")), "ticker", "full_outer").fillna(0.0)
    total = j.agg((F.sum(F.abs(F.col("t") - F.col("p"))) / 2).alias("turn"))
    share = F.when(F.col("turn") > max_turnover, F.lit(max_turnover) / F.col("turn")).otherwise(1.0)
    return j.crossJoin(F.broadcast(total)).select("ticker", (F.col("p") + (F.col("t") - F.col("p")) * share).alias("weight"))


def seed_noise_ic(scored: DataFrame, label: str, seed: int, share: float = 0.05) -> float | None:
    """Mean rank IC of scores with seeded normal noise of ``share`` of their range."""
    lim = scored.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    sd = share * ((lim["b"] or 0.0) - (lim["a"] or 0.0))

    def run(batches):
        for b in batches:
            keys = b["ticker"].astype(str) + b["decision_date"].astype(str)
            noise = [np.random.default_rng([seed, *k.encode()]).normal(0, 1) for k in keys]
            b["score"] = b["score"] + sd * np.array(noise)
            yield b

    s = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()).select("decision_date", "ticker", "score", F.col(label).alias("y"))
    n = s.mapInPandas(run, s.schema)
    n = n.withColumn("r_s", average_rank("score", "decision_date")).withColumn("r_y", average_rank("y", "decision_date"))
    return n.groupBy("decision_date").agg(guarded_corr("r_s", "r_y").alias("ic")).agg(F.avg("ic")).first()[0]
