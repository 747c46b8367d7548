"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter keeps its largest response in a window (max pooling) and a softmax
layer turns these into language probabilities. The network is trained in
numpy on a bounded sample of labelled texts; a document is read whole, window
by window, and its windows' log-probabilities are averaged.

Filters of bytes are sums of table rows, one table per offset. For use, the
tables of neighbouring offsets are folded into tables of byte pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

UNKNOWN = "und"
#: What may be a letter; signs such as fractions and Roman numerals are no letters, although they match.
LETTER = re.compile(r"[^\W\d_]")
WIDTHS = (2, 3, 4)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class ByteConvNet:
    """filters[w]: (w, 256, n) tables; dense: (n_features, n_classes)."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    window: int

    def __post_init__(self):
        self._pairs = None

    def pairs(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width, (offset, table of byte pairs) whose rows add up to the filter."""
        if self._pairs is None:
            self._pairs = {}
            for w, t in self.filters.items():
                parts = []
                for k in range(0, w - 1, 2):
                    parts.append((k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)))
                if w % 2:
                    parts.append((w - 2, np.repeat(t[w - 1][None], 256, 0).reshape(65536, -1)))
                self._pairs[w] = [(k, np.ascontiguousarray(p, np.float32)) for k, p in parts]
        return self._pairs

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: (n, window) bytes -> (n, features) of max-pooled responses."""
        n, length = x.shape
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for w, parts in self.pairs().items():
            last = length - w + 1
            r = None
            for k, t in parts:
                part = t[pair[:, k : k + last]]
                r = part if r is None else r.__iadd__(part)
            out.append(r.max(axis=1))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def log_probs(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        out = [self.pooled(x[i : i + batch]) @ self.dense + self.dense_bias for i in range(0, len(x), batch)]
        z = np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(data: bytes, length: int) -> np.ndarray:
    """The whole text as rows of ``length`` bytes, the last one padded with zeros."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, length)


def train(texts: list[str], langs: list[str], *, window: int = 256, n_filters: int = 16, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Fit the network by Adam on cross-entropy. Repeatable: seeded, ordered input."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    c, nf = len(labels), n_filters * len(WIDTHS)
    x = np.concatenate([windows(t.encode()[:window], window) for t in texts]) if texts else np.zeros((0, window), np.uint8)
    y = np.array([labels.index(v) for v in langs], np.int64)
    weight = len(y) / (max(c, 1) * np.maximum(np.bincount(y, minlength=max(c, 1)), 1))
    par = {f"f{w}": rng.normal(0, 0.3 / w, (w, 256, n_filters)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        par[f"f{w}"][:, 0] = 0  # padding
    par |= {"b": np.zeros(nf, np.float32), "d": rng.normal(0, 0.3, (nf, c)).astype(np.float32), "e": np.zeros(c, np.float32)}
    m = {k: np.zeros_like(v) for k, v in par.items()}
    s = {k: np.zeros_like(v) for k, v in par.items()}
    step = 0
    for _ in range(epochs if c > 1 else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            n = len(yb)
            pooled, where = [], {}
            for w in WIDTHS:
                r = sum(par[f"f{w}"][k][xb[:, k : window - w + 1 + k]] for k in range(w))
                where[w] = r.argmax(axis=1)
                pooled.append(np.take_along_axis(r, where[w][:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + par["b"]
            act = np.maximum(pre, 0)
            z = act @ par["d"] + par["e"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(n), yb] -= 1
            g *= (weight[yb] / n)[:, None].astype(np.float32)
            grad = {"d": act.T @ g, "e": g.sum(0)}
            ga = (g @ par["d"].T) * (pre > 0)
            grad["b"] = ga.sum(0)
            for j, w in enumerate(WIDTHS):
                gw = np.zeros_like(par[f"f{w}"])
                part = ga[:, j * n_filters : (j + 1) * n_filters]
                for k in range(w):
                    at = np.take_along_axis(xb, where[w] + k, 1)
                    np.add.at(gw[k], (at, np.arange(n_filters)[None, :]), part)
                gw[:, 0] = 0
                grad[f"f{w}"] = gw
            step += 1
            for k, v in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                par[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(labels, {w: par[f"f{w}"] for w in WIDTHS}, par["b"], par["d"], par["e"], window)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows that are never learnt from: crc32 of the id as text is a multiple of ``folds``."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds) == 0


def training_sample(docs: DataFrame, *, max_rows: int = 30_000, per_lang: int = 1500, window: int = 256) -> tuple[list[str], list[str]]:
    """A window from each of about ``per_lang`` labelled texts per language, in a fixed order.

    Counts of languages are over all rows; a row is taken by a hash of its id
    and the language's count, so that rare languages are kept whole. All
    languages are learnt: the more there are, the less each has, about
    ``max_rows`` rows together and twenty each.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    # A row for each language.
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return [], []
    per_lang = max(20, min(per_lang, max_rows // len(counts)))
    span = 1_000_000
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(span, int(span * per_lang / r["count"]) + 1)) for r in counts], "lang string, __share long")
    dice = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("learn"))
    start = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("start")), F.greatest(F.lit(1), F.length("text") - window)).cast("int") + 1
    rows = (
        known.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
        .join(F.broadcast(shares), "lang")
        .where(F.pmod(dice, F.lit(span)) < F.col("__share"))
        .select("lang", F.substring("text", start, window).alias("text"), dice.alias("dice"))
        .distinct()  # rows that are the same count once, however many there are
        .collect()
    )
    rows.sort(key=lambda r: (r["dice"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def scorer(net: ByteConvNet):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            langs, scores = [UNKNOWN] * len(b), [0.0] * len(b)
            part: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush():
                if not part:
                    return
                lp = net.log_probs(np.concatenate([w for _, w in part]))
                at = np.cumsum([0] + [len(w) for _, w in part])
                mean = np.add.reduceat(lp, at[:-1], axis=0) / np.diff(at)[:, None]
                e = np.exp(mean - mean.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                best = e.argmax(1)
                for (row, _), k, p in zip(part, best, e):
                    langs[row], scores[row] = net.labels[k], float(p[k])
                part.clear()

            for row, text in enumerate(b["__text"]):
                if isinstance(text, str) and net.labels and has_letter(text):
                    w = windows(text.encode("utf-8", "replace"), net.window)
                    part.append((row, w))
                    held += len(w)
                    if held >= 4096:
                        flush()
                        held = 0
            flush()
            out = b.drop(columns=["__text"])
            out["lang_pred"], out["score"] = langs, scores
            yield out

    return score


def identify(docs: DataFrame, net: ByteConvNet | None = None, *, keep: tuple[str, ...] = ("doc_id",), **sample) -> DataFrame:
    """``keep`` columns, lang_pred, score for every row of ``docs`` (doc_id, text, lang, ...).

    Texts that are null, empty or without letters give ``und`` with score 0;
    so does everything if no row has a label. Repeated rows each give a row;
    further columns are ignored. Only the text takes part in a prediction.
    """
    if net is None:
        net = train(*training_sample(docs, **sample))
    model = docs.sparkSession.sparkContext.broadcast(net)  # under 0.2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in slices(batches, 1000):
            *own, text = b.columns
            (found,) = score(iter([pd.DataFrame({"__text": pd.Series(text.to_pylist(), dtype=object)})]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(found["lang_pred"].tolist(), pa.string()), pa.array(found["score"].tolist(), pa.float64())], [*keep, "lang_pred", "score"])

    form = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(lean(run), f"{form}, lang_pred string, score double")
