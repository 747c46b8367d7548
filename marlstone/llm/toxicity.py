"""Severity of toxicity by cumulative-link ordinal regression.

One weight vector over sparse text features is shared by all ordered
thresholds: P(grade > k) = sigmoid(x.w - theta_k). The expected severity is
the sum of these probabilities over k. Features speak for toxicity or against
it: words, and beginnings of words, whose odds of standing in toxic rows are
far from even.

Grades are taken from the labels where these have them (a column ``grade``, 0
for not toxic). Labels that only say toxic or not leave the grades of toxic
rows open; these are then thirds of toxic rows by a sum of log odds which, for
each row, were counted on the other half of the labelled rows, so that no
row's grade is made of its own label. That severity within toxic rows is an
order by evidence, not a measured one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_az
from .langid import held_out

WORDS = re.compile(WORD)
PREFIXES = (4, 5, 6, 7)


def features_of(word: str) -> list[str]:
    """A word and its leading parts."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(lower_az(text)) if text else []


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def severity(self, score: np.ndarray) -> np.ndarray:
        z = np.clip(score[:, None] - self.thresholds[None, :], -60, 60)
        return (1 / (1 + np.exp(-z))).sum(axis=1)


def counted(texts: list[str]) -> list[Counter]:
    """Per text: in how many distinct words each feature occurs."""
    return [Counter(f for w in set(words_of(t)) for f in features_of(w)) for t in texts]


def log_odds(bags: list[Counter], toxic: list[int], min_rows: int) -> dict[str, float]:
    """Per feature of ``min_rows`` rows or more the log odds ratio of standing in toxic rows."""
    pos, neg = Counter(), Counter()
    for b, t in zip(bags, toxic):
        (pos if t else neg).update(b.keys())
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    return {f: float(np.log(((pos[f] + 0.5) / (n1 + 1)) / ((neg[f] + 0.5) / (n0 + 1)))) for f in pos.keys() | neg.keys() if pos[f] + neg[f] >= min_rows}


def ordered_grades(bags: list[Counter], toxic: list[int], sizes: np.ndarray, grades: int, min_rows: int) -> np.ndarray:
    """Grades of toxic rows: parts of equal size by evidence counted on the other half of the rows."""
    y = np.array(toxic, np.int64)
    dose = np.zeros(len(y))
    half = np.array([zlib.crc32(repr(sorted(b.items())).encode("utf-8", "replace")) % 2 for b in bags], np.int64)
    for h in (0, 1):
        odds = log_odds([b for b, k in zip(bags, half) if k != h], [t for t, k in zip(toxic, half) if k != h], min_rows)
        for r in np.flatnonzero((half == h) & (y == 1)):
            dose[r] = sum(odds.get(f, 0.0) * np.log1p(c) for f, c in bags[r].items()) / np.sqrt(sizes[r])
    out = y.copy()
    if y.sum() >= grades:
        out[y == 1] = 1 + np.searchsorted(np.quantile(dose[y == 1], np.arange(1, grades) / grades), dose[y == 1], side="left")
    return out


def fit(texts: list[str], toxic: list[int], *, grade: list[int] | None = None, grades: int = 3, min_rows: int = 4, min_odds: float = 4.0, max_features: int = 20_000, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> OrdinalModel:
    """Fit weights and ordered thresholds by Adam on the ordinal likelihood; classes weigh the same.

    ``grade``: known grades 0 to ``grades``; without them see above.
    """
    y = np.array(toxic, np.int64)
    bags = counted(texts)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    odds = log_odds(bags, list(toxic), min_rows)
    least = float(np.log(min_odds))
    marked = sorted((f for f, o in odds.items() if abs(o) >= least), key=lambda f: (-abs(odds[f]), f))[:max_features]
    index = {f: i for i, f in enumerate(marked)}
    rows, cols, vals = [], [], []
    for r, b in enumerate(bags):
        for f, c in b.items():
            if f in index:
                rows.append(r)
                cols.append(index[f])
                vals.append(np.log1p(c))
    rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, np.float64)
    if grade is None:
        grade = ordered_grades(bags, list(toxic), np.array([max(1, len(words_of(t))) for t in texts], np.float64), grades, min_rows)
    grade = np.clip(np.array(grade, np.int64), 0, grades)
    w, base, gaps = np.zeros(len(marked)), np.array(1.0), np.zeros(grades - 1)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", w), ("base", base), ("gaps", gaps))}
    target = (grade[:, None] > np.arange(grades)[None, :]).astype(np.float64)
    for t in range(1, (steps if len(texts) and y.any() else 0) + 1):
        score = np.bincount(rows, vals * w[cols], minlength=len(texts))
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        # Binary steps with shared weights: every threshold is one logit of the same score.
        g = (1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -60, 60))) - target) * weight[:, None]
        gs = g.sum(1)
        gt = -g.sum(0)
        grads = {"w": np.bincount(cols, vals * gs[rows], minlength=len(marked)) + l2 * w / max(1, len(marked)) ** 0.5, "base": gt.sum(), "gaps": np.array([gt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 1)])}
        for k, v in (("w", w), ("base", base), ("gaps", gaps)):
            s = state[k]
            s[0] = 0.9 * s[0] + 0.1 * grads[k]
            s[1] = 0.999 * s[1] + 0.001 * grads[k] ** 2
            v -= rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return OrdinalModel(index, w, theta, 0.5)


def training_rows(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, max_chars: int = 20_000) -> tuple[list[str], list[int], list[int] | None]:
    """About ``per_class`` labelled texts of each class, never from the held-out fold, and their grades if there are any.

    Only what is learnt from is bounded (``per_class`` rows, of texts of at
    most ``max_chars`` characters); every document is scored whole. Of rows
    that repeat a doc_id the least text is learnt from, of their labels the
    largest.
    """
    graded = "grade" in labels.columns
    top = [F.max("toxic").alias("toxic"), F.max(F.col("grade") if graded else F.lit(None)).cast("int").alias("grade")]
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(*top).where(~held_out())
    n = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    span = 1_000_000
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(span))
    share = F.when(F.col("toxic") == 1, min(span, int(span * per_class / max(1, n.get(1, 0))) + 1)).otherwise(min(span, int(span * per_class / max(1, n.get(0, 0))) + 1))
    picked = lab.where(dice < share)  # bounded: about 2 * per_class ids
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("grade").alias("grade")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows], [int(r["grade"] or 0) for r in rows] if graded else None


def scorer(model: OrdinalModel):
    get = model.features.get
    memo: dict[str, tuple[int, ...]] = {}
    weights = model.weights

    def hits(word: str) -> tuple[int, ...]:
        found = tuple(i for i in map(get, features_of(word)) if i is not None)
        if len(memo) > 400_000:
            memo.clear()
        memo[word] = found
        return found

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            out = np.zeros(len(b))
            n_words = np.zeros(len(b), np.int64)
            for r, text in enumerate(b["text"]):
                if not isinstance(text, str):
                    continue
                words = words_of(text)
                n_words[r] = len(words)
                c: Counter = Counter()
                for w in set(words):
                    h = memo.get(w)
                    if h is None:
                        h = hits(w)
                    if h:
                        c.update(h)
                if c:
                    at = np.fromiter(c.keys(), np.int64, len(c))
                    out[r] = np.log1p(np.fromiter(c.values(), np.float64, len(c))) @ weights[at]
            sev = model.severity(out)
            res = b.drop(columns=["text"])
            res["n_words"], res["score"], res["severity"] = n_words, out, sev
            res["grade"] = np.minimum(np.floor(sev + 0.5), len(model.thresholds)).astype(np.int32)
            res["toxic"] = out - model.thresholds[0] > 0
            yield res

    return score


def rate(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None, **sample) -> DataFrame:
    """doc_id, n_words, score, severity (0 to 3), grade, toxic for every document.

    A document without words, or null, has score 0 and counts as not toxic.
    Repeated rows each give a row; without labels of both kinds nothing is
    toxic. Further columns are ignored.
    """
    if model is None:
        texts, toxic, grade = training_rows(docs, labels, **sample)
        model = fit(texts, toxic, grade=grade)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_features

    def run(batches):
        return scorer(shared.value)(batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_words long, score double, severity double, grade int, toxic boolean")
