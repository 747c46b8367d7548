"""Queries over neutralised scores, linear models, folds and constrained books, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as k
from ..operators import modeling as m
from ..operators import portfolio as pf
from .base import query
from .models import FULL, IC, LABEL, _corr, _rank, included, rounded, rsql, scored, scored_of

USED = ["earnings_yield", "book_to_market", "roe", "operating_margin", "revenue_growth_yoy", "momentum_60d", "volatility", "max_drawdown"]
EXPOSED = ["momentum_60d", "leverage"]


def _exposed(spark, sf_dir):
    d = included(spark, sf_dir)
    return scored_of(d).join(d.select("decision_date", "ticker", *EXPOSED), ["decision_date", "ticker"])


def _neutral_sql(where: str) -> str:
    """nz: score s, label y, exposures m1 and m2, and the score less its least-squares part by date."""
    return f"""
    n0 AS (SELECT sd.decision_date, score AS s, sd.{LABEL} AS y, momentum_60d AS m1, leverage AS m2 FROM sd JOIN ok USING (decision_date, ticker) WHERE {where}),
    n1 AS (SELECT *, s - avg(s) OVER w AS sc, coalesce(m1 - avg(m1) OVER w, 0) AS a, coalesce(m2 - avg(m2) OVER w, 0) AS b FROM n0 WINDOW w AS (PARTITION BY decision_date)),
    n2 AS (SELECT decision_date, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * sc) AS sa, sum(b * sc) AS sb FROM n1 GROUP BY 1),
    nz AS (SELECT n1.*, s - (a * (sa * bb - sb * ab) + b * (sb * aa - sa * ab)) / (aa * bb - ab * ab) AS neutral FROM n1 JOIN n2 USING (decision_date))"""


@query(f"""{FULL}, {_neutral_sql(f"score IS NOT NULL AND sd.{LABEL} IS NOT NULL")},
    nr AS (SELECT decision_date, {_rank("s")} AS rs, {_rank("round(neutral, 9)")} AS rn, {_rank("y")} AS ry FROM nz),
    nc AS (SELECT decision_date, count(*) AS n, {_corr("rs", "ry")} AS raw_ic, {_corr("rn", "ry")} AS neutral_ic FROM nr GROUP BY 1)
    SELECT decision_date, n, {rsql("raw_ic", "neutral_ic")} FROM nc""")
def neutralized_ic_multi(spark, sf_dir):
    return rounded(k.neutral_rank_ic(_exposed(spark, sf_dir), EXPOSED, LABEL), "raw_ic", "neutral_ic")


def _pairs(x: str, y: str) -> str:
    return f"(SELECT {_corr(x, y)} FROM nz WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


@query(f"""{FULL}, {_neutral_sql("score IS NOT NULL")}
    SELECT 'momentum_60d' AS exposure, round({_pairs("s", "m1")}, 6) + 0.0 AS before, round({_pairs("neutral", "m1")}, 6) + 0.0 AS after
    UNION ALL SELECT 'leverage', round({_pairs("s", "m2")}, 6) + 0.0, round({_pairs("neutral", "m2")}, 6) + 0.0""")
def exposure_diagnostics(spark, sf_dir):
    d = rounded(k.exposure_diagnostics(_exposed(spark, sf_dir), EXPOSED), "before", "after")
    return d.withColumns({c: F.col(c) + 0.0 for c in ("before", "after")})  # no negative zero


def _gram_sql() -> str:
    """gs: counts, and the matrix g (of lists) and vector v of standardised factors, as k.gram() has them."""
    n = len(USED)
    med = ", ".join(f"median({f}) AS md{i}" for i, f in enumerate(USED))
    x = ", ".join(f"coalesce({f}, md{i}, 0)::DOUBLE AS x{i}" for i, f in enumerate(USED))
    cov = ", ".join([f"covar_pop(x{i}, x{j}) AS c{i}_{j}" for i in range(n) for j in range(i, n)] + [f"covar_pop(x{i}, y) AS v{i}" for i in range(n)])
    sd = ", ".join(f"CASE WHEN sqrt(greatest(c{i}_{i}, 0)) > 1e-12 THEN sqrt(c{i}_{i}) ELSE 1 END AS s{i}, sqrt(greatest(c{i}_{i}, 0)) <= 1e-12 AS flat{i}" for i in range(n))
    cell = lambda i, j: f"CASE WHEN flat{i} OR flat{j} THEN 0 ELSE c{min(i, j)}_{max(i, j)} / (s{i} * s{j}) END"
    g = "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(n)) + "]" for i in range(n)) + "]"
    v = "[" + ", ".join(f"CASE WHEN flat{i} THEN 0 ELSE v{i} / s{i} END" for i in range(n)) + "]"
    return f"""
    md AS (SELECT {med} FROM ok WHERE {LABEL} IS NOT NULL),
    gx AS (SELECT {LABEL}::DOUBLE AS y, {x} FROM ok, md WHERE {LABEL} IS NOT NULL),
    gc AS (SELECT count(*) AS n, {cov} FROM gx), gt AS (SELECT *, {sd} FROM gc),
    gs AS (SELECT n, {g} AS g, {v} AS v FROM gt)"""


NAMES = "[" + ", ".join(f"'{f}'" for f in USED) + "]"


def _coef(spark, model):
    return spark.createDataFrame([(f, round(float(c), 6) + 0.0, model.status) for f, c in model.coef.items()], "feature string, coefficient double, status string")


# The normal equations with one added to the diagonal, by elimination: a row of the recursion for each factor.
@query(f"""{FULL.replace("WITH ", "WITH RECURSIVE ", 1)}, {_gram_sql()},
    el(k, a) AS (
        SELECT 1, list_transform(range(1, {len(USED) + 1}), lambda i: list_append(list_transform(range(1, {len(USED) + 1}), lambda j: n * g[i][j] + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END), n * v[i])) FROM gs
        UNION ALL SELECT k + 1, list_transform(range(1, {len(USED) + 1}), lambda i: CASE WHEN i = k THEN list_transform(a[k], lambda x: x / a[k][k]) ELSE list_transform(range(1, {len(USED) + 2}), lambda j: a[i][j] - a[i][k] * a[k][j] / a[k][k]) END)
        FROM el WHERE k <= {len(USED)})
    SELECT unnest({NAMES}) AS feature, round(unnest(list_transform(a, lambda r: r[{len(USED) + 1}])), 6) + 0.0 AS coefficient, 'ok' AS status FROM el WHERE k = {len(USED) + 1}""")
def ridge(spark, sf_dir):
    return _coef(spark, k.ridge(included(spark, sf_dir), USED, LABEL))


# Coordinate descent, a row of the recursion for each step; moved is the largest change of the sweep so far.
@query(f"""{FULL.replace("WITH ", "WITH RECURSIVE ", 1)}, {_gram_sql()},
    cd(t, b, moved, done) AS (
        SELECT 0, list_transform(range(0, {len(USED)}), lambda i: 0.0::DOUBLE), 0.0::DOUBLE, FALSE
        UNION ALL SELECT t + 1, list_transform(range(1, {len(USED) + 1}), lambda i: CASE WHEN i = k THEN new ELSE b[i] END),
               greatest(CASE WHEN k = 1 THEN 0 ELSE moved END, abs(new - b[k])), k = {len(USED)} AND greatest(moved, abs(new - b[k])) < 1e-8
        FROM (SELECT *, CASE WHEN gk[k] <= 0 THEN b[k] ELSE sign(rho) * greatest(abs(rho) - 0.05::DOUBLE * 0.5::DOUBLE, 0) / (gk[k] + 0.05::DOUBLE * 0.5::DOUBLE) END AS new
              FROM (SELECT *, vk - list_sum(list_transform(range(1, {len(USED) + 1}), lambda i: gk[i] * b[i])) + gk[k] * b[k] AS rho
                    FROM (SELECT cd.*, t % {len(USED)} + 1 AS k, g[t % {len(USED)} + 1] AS gk, v[t % {len(USED)} + 1] AS vk FROM cd, gs WHERE NOT done AND t < {1000 * len(USED)}) AS c0) AS c1) AS c2)
    SELECT unnest({NAMES}) AS feature, round(unnest(b), 6) + 0.0 AS coefficient, CASE WHEN done THEN 'ok' ELSE 'not_converged' END AS status FROM (SELECT * FROM cd ORDER BY t DESC LIMIT 1) AS last""")
def elastic_net(spark, sf_dir):
    return _coef(spark, k.elastic_net(included(spark, sf_dir), USED, LABEL))


@query()
def permutation_importance(spark, sf_dir):
    """No SQL: values are dealt by Spark's hash of the keys. A unit test deals them by hand."""
    d = included(spark, sf_dir)
    return k.permutation_importance(d, k.ridge(d, USED[:3], LABEL), LABEL)


BOOK = f"""
ka AS (SELECT decision_date, ticker, sector, score, {LABEL} AS ret, count(*) OVER (PARTITION BY decision_date) AS universe, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker DESC) AS rn
       FROM sd WHERE score IS NOT NULL AND {LABEL} IS NOT NULL),
kb AS (SELECT *, greatest(1, CAST(floor(universe * 0.2::DOUBLE) AS BIGINT)) AS k FROM ka),
kc AS (SELECT *, CASE WHEN rn <= k THEN 'long' ELSE 'short' END AS leg, CASE WHEN rn <= k THEN rn ELSE universe - rn + 1 END AS place FROM kb WHERE (rn <= k OR universe - rn + 1 <= k) AND 2 * k <= universe),
kp AS (SELECT decision_date, ticker, sector, leg, (k - place + 1) / (k * (k + 1) / 2.0::DOUBLE) AS weight FROM kc)"""


def _constrain_sql(source: str, max_weight: float, sector_cap: float) -> str:
    return f"""
    k1 AS (SELECT *, sum(weight) OVER w AS gross, sum(CASE WHEN weight > {max_weight}::DOUBLE + 1e-12 THEN weight - {max_weight}::DOUBLE ELSE 0 END) OVER w AS excess,
                  CASE WHEN weight > {max_weight}::DOUBLE + 1e-12 THEN 0 ELSE greatest({max_weight}::DOUBLE - weight, 0) END AS room FROM {source} WINDOW w AS (PARTITION BY decision_date, leg)),
    k2 AS (SELECT *, sum(room) OVER (PARTITION BY decision_date, leg) AS rooms FROM k1),
    k3 AS (SELECT *, CASE WHEN weight > {max_weight}::DOUBLE + 1e-12 THEN {max_weight}::DOUBLE ELSE weight + CASE WHEN rooms > 1e-12 THEN least(1, excess / rooms) ELSE 0 END * room END AS c1 FROM k2),
    k4 AS (SELECT *, sum(c1) OVER (PARTITION BY decision_date, leg, coalesce(nullif(sector, ''), 'unknown')) AS part FROM k3),
    k5 AS (SELECT *, CASE WHEN part > {sector_cap}::DOUBLE + 1e-12 THEN c1 * {sector_cap}::DOUBLE / part ELSE c1 END AS c2 FROM k4),
    k6 AS (SELECT *, sum(c2) OVER (PARTITION BY decision_date, leg) < gross - 1e-9 AS less FROM k5),
    k7 AS (SELECT *, CASE WHEN bool_or(less) OVER (PARTITION BY decision_date) THEN 'feasible_reduced' ELSE 'ok' END AS status FROM k6)"""


@query(f"""{FULL}, {BOOK}, {_constrain_sql("kp", 0.08, 0.4)} SELECT decision_date, ticker, leg, round(c2, 6) AS weight, status FROM k7""")
def constrained_portfolio(spark, sf_dir):
    p = pf.positions(scored(spark, sf_dir), LABEL, rank_weighted=True)
    return k.constrain(p, max_weight=0.08, sector_cap=0.4).select("decision_date", "ticker", "leg", F.round("constrained", 6).alias("weight"), "status")


@query(f"""{FULL}, {BOOK}, kq AS (SELECT *, row_number() OVER (PARTITION BY decision_date, leg ORDER BY weight DESC, ticker) AS place, count(*) OVER (PARTITION BY decision_date, leg) AS names, sum(weight) OVER (PARTITION BY decision_date, leg) AS gross FROM kp),
    kr AS (SELECT *, CASE WHEN min(names) OVER (PARTITION BY decision_date) < 15 THEN 'too_few_names' END AS reason, CASE WHEN names >= 15 AND place <= 12 THEN weight ELSE 0 END AS w0 FROM kq),
    ks AS (SELECT *, CASE WHEN sum(w0) OVER (PARTITION BY decision_date, leg) > 0 THEN w0 / sum(w0) OVER (PARTITION BY decision_date, leg) * gross ELSE 0 END AS w FROM kr)
    SELECT decision_date, ticker, leg, round(w, 6) AS weight, CASE WHEN reason IS NULL THEN 'ok' ELSE 'infeasible' END AS status, reason FROM ks""")
def limited_names_portfolio(spark, sf_dir):
    """The twelve largest names of each leg; dates with legs of fewer than fifteen are infeasible."""
    p = pf.positions(scored(spark, sf_dir), LABEL, rank_weighted=True)
    return k.constrain(p, max_names=12, min_names=15).select("decision_date", "ticker", "leg", F.round("constrained", 6).alias("weight"), "status", "reason")


@query(f"""{FULL}, {IC}, fd AS (SELECT decision_date, row_number() OVER (ORDER BY decision_date) - 1 AS i FROM (SELECT DISTINCT decision_date FROM sd))
    SELECT CAST(i - 2 AS INTEGER) AS fold, decision_date, round(ic, 6) AS ic FROM ic JOIN fd USING (decision_date) WHERE i >= 2""")
def fold_metrics(spark, sf_dir):
    """Rank IC of each walk-forward fold's test dates."""
    s = scored(spark, sf_dir)
    folds = pf.walk_forward(spark, s.select("decision_date"), min_train=2).where("role = 'test'").select("fold", "decision_date")
    return m.rank_ic(s, LABEL).join(folds, "decision_date").select("fold", "decision_date", F.round("ic", 6).alias("ic"))


@query()
def boosted_rank_ic(spark, sf_dir):
    """Rank correlation, date by date, of the boosted ranker's scores on the rows that it learnt from."""
    from ..operators import boosting as b

    d = included(spark, sf_dir).withColumn(LABEL, F.round(LABEL, 9))
    r = b.train(d, b.RANKER, 20)
    return rounded(m.rank_ic(r.scored, LABEL), "ic", "sector_neutral_ic")


@query()
def boosted_importance(spark, sf_dir):
    """Shares of the boosted regression's gain by factor."""
    from ..operators import boosting as b

    d = included(spark, sf_dir).withColumn(LABEL, F.round(LABEL, 9))
    r = b.train(d, b.REGRESSOR, 20)
    return spark.createDataFrame([(f, round(s, 6)) for f, s in r.model.importance()], "feature string, share double")
