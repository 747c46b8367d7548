"""Constrained books against a plain walk through the rules, one date at a time."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import kernels as k


def by_hand(legs, *, max_weight=None, sector_cap=None, max_names=None, min_names=None, min_adv=None, max_participation=None, notional=1.0, prior=None, max_turnover=None):
    """{leg: {name: weight}}, status, reason from {leg: [(name, weight, sector, adv)]}."""
    out, gross, reasons = {}, {}, []
    for leg in ("long", "short"):
        rows = legs[leg]
        gross[leg] = sum(w for _, w, *_ in rows)
        left = [r for r in rows if min_adv is None or (r[3] or 0.0) >= min_adv]
        if min_adv is not None and not left or min_names is not None and len(left) < min_names:
            reasons.append("all_names_fail_liquidity" if not left and min_adv is not None else "too_few_names")
            out[leg] = {}
            continue
        if max_names is not None:
            left = sorted(left, key=lambda r: (-r[1], r[0]))[:max_names]
        total = sum(r[1] for r in left)
        w = {r[0]: r[1] / total * gross[leg] for r in left}
        caps = {r[0]: min([x for x in (max_weight, None if max_participation is None else max_participation * (r[3] or 0.0) / notional) if x is not None], default=float("inf")) for r in left}
        if any(c < float("inf") for c in caps.values()):
            for _ in range(50):
                over = [n for n in w if w[n] > caps[n] + 1e-12]
                if not over:
                    break
                excess = sum(w[n] - caps[n] for n in over)
                w.update({n: caps[n] for n in over})
                room = {n: caps[n] - w[n] for n in w if n not in over and caps[n] > w[n]}
                if sum(room.values()) <= 1e-12:
                    break
                total = sum(room.values())
                w.update({n: w[n] + excess * r / total for n, r in room.items()})
        if sector_cap is not None:
            sec = {r[0]: r[2] or "unknown" for r in left}
            tot = {s: sum(w[n] for n in w if sec[n] == s) for s in set(sec.values())}
            w = {n: x * (sector_cap / tot[sec[n]] if tot[sec[n]] > sector_cap + 1e-12 else 1.0) for n, x in w.items()}
        out[leg] = w
    if reasons:
        return out, "infeasible", reasons[0]
    if prior is not None:
        book = {**out["long"]}
        for n, x in out["short"].items():
            book[n] = book.get(n, 0.0) - x
        names = set(book) | set(prior)
        turn = sum(abs(book.get(n, 0.0) - prior.get(n, 0.0)) for n in names) / 2
        if turn > max_turnover + 1e-12:
            moved = {n: prior.get(n, 0.0) + max_turnover / turn * (book.get(n, 0.0) - prior.get(n, 0.0)) for n in names}
            out = {"long": {n: x for n, x in moved.items() if x > 1e-12}, "short": {n: -x for n, x in moved.items() if x < -1e-12}}
    less = any(sum(out[leg].values()) < gross[leg] - 1e-9 for leg in out)
    return out, "feasible_reduced" if less else "ok", None


RULES = [
    dict(max_weight=0.3), dict(max_weight=0.1), dict(max_weight=0.35, sector_cap=0.4), dict(max_names=3), dict(min_names=7), dict(min_names=6, max_names=2, max_weight=0.6),
    dict(min_adv=50.0), dict(min_adv=1000.0), dict(max_participation=0.004), dict(max_weight=0.3, min_adv=20.0, max_participation=0.01, sector_cap=0.5),
]


@pytest.mark.parametrize("turnover", [None, 0.3])
def test_rules_like_by_hand(spark, turnover):
    rng = random.Random(2)
    dates = {}
    for d in range(6):
        legs = {}
        for leg in ("long", "short"):
            raw = [rng.random() + 0.05 for _ in range(6)]
            legs[leg] = [(f"{leg[0]}{i}", w / sum(raw), rng.choice(["a", "b", None, ""]), rng.choice([None, 10.0, 60.0, 90.0])) for i, w in enumerate(raw)]
        dates[f"2024-0{d + 1}-01"] = legs
    d = spark.createDataFrame([(day, leg, *r) for day, legs in dates.items() for leg, rows in legs.items() for r in rows], "decision_date string, leg string, ticker string, weight double, sector string, adv double").cache()
    prior = {"l0": 0.5, "gone": 0.5, "s0": -0.4, "old": -0.6}
    book = spark.createDataFrame([(day, n, w) for day in dates for n, w in prior.items()], "decision_date string, ticker string, weight double")
    for rule in RULES if turnover is None else RULES[:3]:
        extra = {} if turnover is None else {"prior": book, "max_turnover": turnover}
        got, state = {}, {}
        for r in k.constrain(d, **rule, **extra).collect():
            state[r["decision_date"]] = (r["status"], r["reason"])
            if abs(r["constrained"]) > 1e-12:
                got.setdefault((r["decision_date"], r["leg"]), {})[r["ticker"]] = r["constrained"]
        for day, legs in dates.items():
            want, status, reason = by_hand(legs, **rule, **({} if turnover is None else {"prior": prior, "max_turnover": turnover}))
            assert state[day] == (status, reason), (rule, day)
            for leg in legs:
                mine, other = got.get((day, leg), {}), {n: x for n, x in want[leg].items() if x > 1e-12}
                assert mine.keys() == other.keys() and all(abs(mine[n] - other[n]) < 1e-9 for n in mine), (rule, day, leg)


def test_caps_by_adv_need_adv(spark):
    d = spark.createDataFrame([("d", "long", "a", 1.0, "x"), ("d", "short", "b", 1.0, "x")], "decision_date string, leg string, ticker string, weight double, sector string")
    r = k.constrain(d, min_adv=1.0, max_weight=0.5).collect()
    assert {x["status"] for x in r} == {"liquidity_data_missing"} and all(x["constrained"] == 1.0 for x in r)
    assert {x["status"] for x in k.constrain(d, min_adv=1.0, max_weight=0.5, allow_without_adv=True).collect()} == {"feasible_reduced"}
    assert k.constrain(d.limit(0), max_weight=0.5).count() == 0


def test_permutation_importance_deals_within_dates(spark):
    rows = [(f"d{i % 3}", f"t{i:02d}", float(i * 7 % 11), float(i * 5 % 13), float(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "decision_date string, ticker string, a double, b double, y double")
    model = k.ridge(d, ["a", "b"], "y")
    got = {r["feature"]: r["importance"] for r in k.permutation_importance(d, model, "y", seed=3).collect()}

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    def corr(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        num = sum((a - mx) * (b - my) for a, b in zip(x, y))
        return num / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    def ic(values):
        out = []
        for day in ("d0", "d1", "d2"):
            here = [r for r in rows if r[0] == day]
            pred = [round(model.intercept + sum((values[r[1]][f] - model.mean[f]) / model.scale[f] * model.coef[f] for f in ("a", "b")), 9) for r in here]
            out.append(corr(rank(pred), rank([r[4] for r in here])))
        return sum(out) / 3

    plain = {r[1]: {"a": r[2], "b": r[3]} for r in rows}
    for f in ("a", "b"):
        hashes = {r["ticker"]: r["h"] for r in d.select("ticker", F.xxhash64("decision_date", "ticker", F.lit(f), F.lit(3)).alias("h")).collect()}
        dealt = {n: dict(v) for n, v in plain.items()}
        for day in ("d0", "d1", "d2"):
            names = sorted(r[1] for r in rows if r[0] == day)
            for giver, taker in zip(names, sorted(names, key=lambda n: (hashes[n], n))):
                dealt[taker][f] = plain[giver][f]
        assert abs(got[f] - (ic(plain) - ic(dealt))) < 1e-9


def test_neutral_scores_are_least_squares_residuals(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(f"d{i % 2}", f"t{i}", rng.random() if i % 9 else None, rng.random() if i % 5 else None, 1.0 if i % 2 else rng.random()) for i in range(40)]
    d = spark.createDataFrame(rows, "decision_date string, ticker string, score double, x1 double, x2 double")
    got = {r["ticker"]: r["neutral"] for r in k.neutralise(d, ["x1", "x2"]).collect()}
    assert len(got) == 40
    for day in ("d0", "d1"):
        here = [r for r in rows if r[0] == day]
        want = k.residual(np.array([np.nan if r[2] is None else r[2] for r in here]), np.array([[np.nan if x is None else x for x in r[3:]] for r in here]))
        for r, w in zip(here, want):
            assert (got[r[1]] is None) == bool(np.isnan(w)) and (got[r[1]] is None or abs(got[r[1]] - w) < 1e-9)
