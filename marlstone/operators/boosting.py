"""Boosted trees over binned factors, grown level by level from histograms.

What a level needs of the rows is a sum of gradients for each node, factor and
bin: one aggregation with partial sums, some thousand rows in the end. The
ranker's loss is that of all pairs of a date whose labels differ in relevance,
squared below a margin of one; its gradient follows from counts and sums for
each date and relevance, so no pairs are made. Scores and gradients are whole
numbers of a small unit: sums are exact, and trees don't depend on how rows
are dealt.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranks_within
from ..sources.scratch import drop, written
from .modeling import FACTORS

#: Scores, gradients and second derivatives are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Models and outcomes.
RANKER, REGRESSOR = "boosted_ranker", "boosted_regressor"
FOREIGN = {"lightgbm_ranker": "lightgbm", "lightgbm_regressor": "lightgbm", "catboost_ranker": "catboost", "catboost_regressor": "catboost"}
TRAINED, MISSING, TOO_FEW = "trained", "optional_dependency_missing", "insufficient_data"


@dataclass
class Tree:
    """Inner nodes by number (1 is the root, the children of k are 2k and 2k + 1): factor and last bin that goes left; values of leaves."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, int] = field(default_factory=dict)

    def at(self, bins: Column, leaf, k: int = 1) -> Column:
        if k not in self.splits:
            return leaf(k)
        f, t = self.splits[k]
        return F.when(bins[f] <= t, self.at(bins, leaf, 2 * k)).otherwise(self.at(bins, leaf, 2 * k + 1))

    def node(self, bins: Column) -> Column:
        return self.at(bins, lambda k: F.lit(k))

    def value(self, bins: Column) -> Column:
        return self.at(bins, lambda k: F.lit(self.values[k]).cast("long"))


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def bins(self) -> Column:
        """Each factor's bin: 0 if it is missing, else one more than the number of edges below it."""

        def one(x: Column, edges: list[float]) -> Column:
            below = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < x)) if edges else F.lit(0)
            return F.when(x.isNull() | F.isnan(x), 0).otherwise(below + 1).cast("tinyint")

        return F.array(*[one(F.col(f).cast("double"), edges) for f, edges in zip(self.features, self.edges)])

    def predict(self, df: DataFrame, name: str = "score") -> DataFrame:
        d = df.withColumn("__bins", self.bins())
        total = F.lit(0).cast("long")
        for t in self.trees:
            total = total + t.value(F.col("__bins"))
        return d.withColumn(name, total / F.lit(float(UNIT))).drop("__bins")

    def importance(self) -> list[tuple[str, float]]:
        """Shares of the gain, largest first."""
        total = sum(self.gains)
        return sorted(((f, g / total if total else 0.0) for f, g in zip(self.features, self.gains)), key=lambda p: (-p[1], p[0]))


def relevance(rows: DataFrame, label: str, by: str = "decision_date", n: int = 5) -> DataFrame:
    """Adds ``relevance``: the label's bucket of n within its date, by mean ranks; 0 on dates with fewer names. Unlabelled rows go."""
    d = rows.where(F.col(label).isNotNull())
    sizes = d.groupBy(by).agg(F.count("*").alias("__names"))
    d = ranks_within(d.join(sizes, by), [by], {"__place": label})
    bucket = F.least(F.lit(n - 1), F.floor((F.col("__place") - 1) / F.col("__names") * n))
    return d.withColumn("relevance", F.when(F.col("__names") < n, 0).otherwise(bucket).cast("int")).drop("__names", "__place")


def _ranking(work: DataFrame, n: int) -> DataFrame:
    """Adds g and h of the loss over all pairs of a date. A date's rows weigh two in all on average, however many they are."""
    levels = work.groupBy("date").agg(
        F.count("*").alias("rows"),
        F.array(*[F.count_if(F.col("y") == k) for k in range(n)]).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("s"))), F.lit(0)) for k in range(n)]).alias("t"),
    )
    pairs = sum(F.col("n")[a] * F.col("n")[b] for a in range(n) for b in range(a))
    levels = levels.withColumn("w", F.when(pairs > 0, F.col("rows") / pairs).otherwise(0.0))
    d = work.join(levels, "date")
    s, y = F.col("s"), F.col("y")
    # To a lower level a row should keep a distance of one above, to a higher one below.
    other = [F.when(y == k, 0).otherwise(F.col("n")[k] * (s + F.when(y > k, -UNIT).otherwise(UNIT)) - F.col("t")[k]) for k in range(n)]
    many = [F.when(y == k, 0).otherwise(F.col("n")[k]) for k in range(n)]
    g, h = sum(other[1:], other[0]), sum(many[1:], many[0])
    return d.withColumn("g", F.round(g * F.col("w")).cast("long")).withColumn("h", F.round(h * F.col("w") * UNIT).cast("long")).select("date", "bins", "y", "s", "g", "h")


def _squares(work: DataFrame, n: int) -> DataFrame:
    return work.withColumn("g", F.col("s") - F.col("y")).withColumn("h", F.lit(UNIT).cast("long"))


def best_split(cells: Iterable[tuple[int, int, int, int, int]], smooth: float, least: int) -> tuple[float, int, int, tuple[int, int], tuple[int, int]] | None:
    """(gain, factor, bin, left (g, h), right (g, h)) from cells (factor, bin, g, h, rows) of a node; ties go to the smaller factor, then bin."""
    by_factor: dict[int, list[tuple[int, int, int, int]]] = {}
    for f, b, g, h, n in cells:
        by_factor.setdefault(f, []).append((b, g, h, n))
    best = None
    for f in sorted(by_factor):
        parts = sorted(by_factor[f])
        all_g, all_h, all_n = (sum(p[k] for p in parts) for k in (1, 2, 3))
        left_g = left_h = left_n = 0
        for b, g, h, n in parts[:-1]:
            left_g, left_h, left_n = left_g + g, left_h + h, left_n + n
            if left_n < least or all_n - left_n < least:
                continue
            gain = score(left_g, left_h, smooth) + score(all_g - left_g, all_h - left_h, smooth) - score(all_g, all_h, smooth)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, f, b, (left_g, left_h), (all_g - left_g, all_h - left_h))
    return best


def score(g: int, h: int, smooth: float) -> float:
    return (g / UNIT) ** 2 / (h / UNIT + smooth)


def leaf(g: int, h: int, smooth: float, rate: float) -> int:
    return round(-rate * g / (h / UNIT + smooth))


def fit(rows: DataFrame, features: list[str], target: str, *, ranking: bool = True, by: str = "decision_date", levels: int = 5, trees: int = 10, depth: int = 3, rate: float = 0.1, bins: int = 32, smooth: float = 1.0, least: int = 5, cut: int = 4) -> Boosted:
    """Trees on ``rows`` by, features and target: a relevance from 0 to levels - 1 if ``ranking``, else a number.

    A missing factor is below all values. ``cut``: after so many trees the
    scores are written, which keeps plans short and cuts their lineage.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(target).isNotNull())
    shares = [k / bins for k in range(1, bins)]
    # Some dozen numbers for each factor.
    q = known.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    model = Boosted(features, [sorted(set(q[f"q{i}"] or ())) for i in range(len(features))], [], [0.0] * len(features))
    y = F.col(target).cast("long") if ranking else F.round(F.col(target) * UNIT).cast("long")
    work, path = written(known.select(F.col(by).alias("date"), model.bins().alias("bins"), y.alias("y"), F.lit(0).cast("long").alias("s")))
    for k in range(trees):
        gradients = (_ranking if ranking else _squares)(work, levels)
        tree = Tree()
        front, sums = {1}, {}
        for _ in range(depth):
            cells = gradients.select(tree.node(F.col("bins")).alias("node"), F.posexplode("bins").alias("f", "b"), "g", "h").where(F.col("node").isin(*front))
            # Bounded: nodes of a level times factors times bins.
            found = cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
            after = set()
            for node in sorted(front):
                mine = [(r["f"], r["b"], r["g"], r["h"], r["n"]) for r in found if r["node"] == node]
                if node == 1:
                    sums[1] = tuple(sum(c[j] for c in mine if c[0] == 0) for j in (2, 3))
                best = best_split(mine, smooth, least)
                if best is not None:
                    gain, f, b, left, right = best
                    model.gains[f] += gain
                    tree.splits[node] = (f, b)
                    sums[2 * node], sums[2 * node + 1] = left, right
                    after |= {2 * node, 2 * node + 1}
            front = after
            if not front:
                break
        tree.values = {node: leaf(*gh, smooth, rate) for node, gh in sums.items() if node not in tree.splits}
        model.trees.append(tree)
        if not tree.splits:
            break  # nothing is left to tell apart
        work = work.withColumn("s", F.col("s") + tree.value(F.col("bins")))
        if (k + 1) % cut == 0 and k + 1 < trees:
            work, new = written(work)
            drop(spark, path)
            path = new
    drop(spark, path)
    return model


@dataclass
class Result:
    """What became of a training: the status, and, if it is ``trained``, the model and the rows with their score."""

    kind: str
    status: str
    message: str = ""
    missing: str | None = None
    model: Boosted | None = None
    scored: DataFrame | None = None


def train(dataset: DataFrame, kind: str, horizon: int = 20, *, levels: int = 5, **options) -> Result:
    """Train on the dataset's rows with a label of that horizon, and score them.

    Models of libraries that aren't installed are skipped, not failed; this
    library has no adapters for them.
    """
    if kind in FOREIGN:
        library = FOREIGN[kind]
        there = importlib.util.find_spec(library) is not None
        return Result(kind, MISSING, f"{library} is there, but has no adapter; use {RANKER} or {REGRESSOR}" if there else f"{library} is not installed; {kind} is skipped", None if there else library)
    if kind not in (RANKER, REGRESSOR):
        raise ValueError(f"unknown model {kind}; known are {(RANKER, REGRESSOR, *FOREIGN)}")
    label = f"forward_return_h{horizon}"
    rows, path = written(relevance(dataset.select("decision_date", "ticker", "sector", *FACTORS, label), label, n=levels))
    n = rows.count()
    if n < levels + 1:
        drop(dataset.sparkSession, path)
        return Result(kind, TOO_FEW, f"too few labelled rows: {n}")
    model = fit(rows, list(FACTORS), "relevance" if kind == RANKER else label, ranking=kind == RANKER, levels=levels, **options)
    return Result(kind, TRAINED, model=model, scored=model.predict(rows).select("decision_date", "ticker", "sector", "score", label))
