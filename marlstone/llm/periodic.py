"""Stretches of words that repeat with a period, found tile by tile.

A document is exploded into overlapping tiles for each octave of periods; a
tile's length goes with its periods. In a tile, equal steps apart, stand
boundaries, and a stretch of words that equal those a period later, if it is
long enough for a run, holds one. Z-functions of the words after a boundary,
and of those before it read backwards, give for each period how far equality
reaches from there; none looks further than a step. Fragments that touch are
one: they are stitched after a shuffle by document and period.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import slices, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods of the first octave are below this; the next ones double. Boundaries are as far apart.
FIRST = 16
#: Words of a tile between its overlaps, for periods that are small against it.
TILE = 1 << 15
#: Codes and words that go on to be solved at once.
HELD = 1 << 18


def octaves(n: int) -> Iterator[tuple[int, int]]:
    """Periods (least, end) of the octaves that a text of n words needs."""
    lo, hi = 1, FIRST
    while LEAST_PERIODS * lo <= n and n >= LEAST_WORDS:
        yield lo, hi
        lo, hi = hi, 2 * hi


def least_equal(q: int) -> int:
    """How many words in a row equal those a period later, in the shortest run."""
    return max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)


def z_function(x: list[int]) -> list[int]:
    """For each place, how many items from there on are those from 0 on."""
    n = len(x)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@functools.lru_cache(1 << 16)
def _parts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def _promising(c: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods where equality reaches half a step ahead or back (or 64 words): no run is without."""
    size = min(len(c), int(at[-1]) + hi) - int(at[0])
    seen = np.lib.stride_tricks.sliding_window_view(c[int(at[0]) : int(at[0]) + size], hi)[at - at[0]]
    row, col = np.nonzero(seen[:, lo:] == c[at][:, None])
    b, q = at[row], lo + col
    half = min(hi // 2, 64)
    ways = []
    for steps in (range(1, half), range(-1, -half - 1, -1)):
        i = np.arange(len(b))
        for k in steps:
            i = i[c[b[i] + k] == c[b[i] + q[i] + k]]
            if not len(i):
                break
        ways.append(i)
    i = np.union1d(*ways)
    return b[i], q[i]


def solve(codes: np.ndarray, base: int, first: int, last: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of stretches of a tile whose words equal those a period later.

    ``codes`` are the words from ``base`` on; boundaries stand at multiples of
    the step from ``first`` to ``last``. Periods are the least ones of their
    stretches. A stretch too short for a run is left out, unless it may go on
    outside the tile.
    """
    step = hi
    pad = 2 * hi + 64
    # Words that stand outside equal none inside.
    c = np.concatenate([np.full(pad, -1, np.int32), codes.astype(np.int32), np.full(pad, -2, np.int32)])
    begin, end = pad, pad + len(codes)
    found_b, found_q = _promising(c, np.arange(first, last + 1, step) - base + pad, lo, hi)
    open_: dict[int, list] = {}
    out: list[tuple[int, int, int]] = []

    def close(q: int, s: int, e: int, goes_on: bool) -> None:
        if goes_on or e - s >= least_equal(q):
            out.append((q, s + base - pad, e + base - pad))

    cuts = np.flatnonzero(np.diff(found_b)) + 1
    for where, periods in zip(found_b[np.r_[0, cuts]].tolist() if len(found_b) else [], np.split(found_q, cuts)):
        ahead = z_function(c[where : min(where + step + hi, end)].tolist())
        top, back = min(where + hi - 1, end), max(where - step, begin)
        before = c[back:where][::-1].tolist()
        behind = z_function([*before, -9, *c[back:top][::-1].tolist()])
        for q in periods.tolist():
            if any(ahead[p] >= q - p for p in _parts(q) if p < q):
                continue  # the words of one period repeat within it
            f, r = min(ahead[q], step), behind[len(before) + 1 + top - where - q]
            s, e = where - r, where + f
            if q in open_ and s <= open_[q][1]:
                open_[q][1:3] = [e, f == step]
                continue
            if q in open_:
                close(q, open_[q][0], open_[q][1], open_[q][2] or open_[q][3])
            open_[q] = [s, e, f == step, r == step]
    for q, (s, e, right, left) in open_.items():
        close(q, s, e, right or left)
    return out


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(least period, end of periods, place of the first code, first and last boundary, codes) of all tiles of a text."""
    n = len(codes)
    for lo, hi in octaves(n):
        core = max(TILE, 4 * hi)  # a multiple of the step
        for at in range(0, n, core):
            last = min(at + core, n - 1) // hi * hi
            last = last if last < at + core else last - hi
            base, end = max(0, at - hi), min(n, last + 2 * hi)
            yield lo, hi, base, at, last, codes[base:end]


_LONG = pa.int64()
TILE_FIELDS = pa.schema([("row", _LONG), ("doc_id", _LONG), ("n", _LONG), ("text", pa.string()), *[(k, _LONG) for k in ("lo", "hi", "base", "first", "last")], ("codes", pa.binary())])
FOUND_FIELDS = pa.schema([("row", _LONG), ("doc_id", _LONG), ("n", _LONG), ("text", pa.string()), ("collapsed_sha256", pa.string()), *[(k, _LONG) for k in ("period", "start", "end")]])


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def _explode(change: Callable[[int | None, list[str]], list[str]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, rows, size = TaskContext.get().partitionId() << 33, [], 0
        for b in slices(batches):
            for doc, text in zip(*[c.to_pylist() for c in b.columns]):
                words = WORDS.findall(text or "")
                words = change(doc, words) if change else words
                known: dict[str, int] = {}
                codes = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
                for lo, hi, base, first, last, part in tiles(codes):
                    rows.append((row, None, None, None, lo, hi, base, first, last, part.tobytes()))
                    size += len(part)
                    if size > HELD:
                        yield _batch(rows, TILE_FIELDS)
                        rows, size = [], 0
                # A text's own row comes after its tiles.
                rows.append((row, doc, len(words), " ".join(words), *[None] * 6))
                size += len(words)
                row += 1
                if size > HELD:
                    yield _batch(rows, TILE_FIELDS)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, TILE_FIELDS)

    return run


def _solve(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = -1
        for b in slices(batches):
            out = []
            for row, doc, n, text, lo, hi, base, first, last, codes in zip(*[c.to_pylist() for c in b.columns]):
                if codes is None:
                    digest = None if hit == row else hashlib.sha256(text.encode()).hexdigest()
                    out.append((row, doc, n, text if hit == row or texts else None, digest, None, None, None))
                    continue
                for q, s, e in solve(np.frombuffer(codes, np.int32), base, first, last, lo, hi):
                    hit = row
                    out.append((row, None, None, None, None, q, s, e))
            yield _batch(out, FOUND_FIELDS)

    return run


def stitched(fragments: DataFrame) -> DataFrame:
    """row, start, length, period of the runs: fragments (row, period, start, end) that touch are one stretch."""
    w = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isles = fragments.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    whole = isles.groupBy("row", "period", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    same = F.col("end") - F.col("start")
    q = F.col("period")
    whole = whole.where(same >= F.greatest(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q))
    return whole.select("row", "start", (same + q).alias("length"), "period")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words that a run holds after its first period."""
    for b in slices(batches):
        out = []
        for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist()):
            words = text.split(" ")
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs or ():
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            out.append(" ".join([w for w, k in zip(words, np.cumsum(edge).tolist()) if not k]))
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def find(docs: DataFrame, *, texts: bool = True, change: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed and collapsed_sha256 of each row.

    A run is a stretch of words with its smallest period, of three periods and
    24 words at least, that can't be longer on either side. ``collapsed`` are
    the words, joined by one space, that no run holds after its first period;
    only its digest is given if ``texts`` is false, so that texts without
    runs, most of them, need not be kept. ``change`` may give other words for
    a doc_id and its words.

    Rows are worked on one by one, whatever their doc_id: repeated rows and
    rows without doc_id have results of their own. A null, empty or blank text
    has no words, no runs and the empty text; an empty table gives no rows.
    Texts are worked on whole, in time that goes with their length and its
    logarithm. Further columns, of any name, are ignored.

    Tiles are solved in the task that makes them, some at a time: dealing them
    out would move each text once for every octave. Texts that have fragments, and only
    those, are shuffled, by a number of their row that no two have.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    explode, solved = _explode(change), _solve(texts)
    found, _ = written(narrow.mapInArrow(lambda batches: solved(explode(batches)), from_arrow_schema(FOUND_FIELDS)))
    runs = stitched(found.where("period IS NOT NULL").select("row", "period", "start", "end"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select("row", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    rows = found.where("period IS NULL")
    plain = rows.where("collapsed_sha256 IS NOT NULL").select("doc_id", F.col("n").alias("n_words"), none.alias("runs"), F.col("text").alias("collapsed"), "collapsed_sha256")
    held = rows.where("collapsed_sha256 IS NULL").select("row", "doc_id", "n", "text").join(runs.hint("shuffle_hash"), "row", "left").select("doc_id", "n", "text", "runs")
    held = held.mapInArrow(_collapse, held.schema)
    held = held.select("doc_id", F.col("n").alias("n_words"), F.coalesce("runs", none).alias("runs"), F.col("text").alias("collapsed"), F.sha2("text", 256).alias("collapsed_sha256"))
    out = plain.unionByName(held)
    return out if texts else out.drop("collapsed")


def _more_periods(a: Column, b: Column) -> Column:
    """Order of two runs: more periods first, as exact fractions; then the smaller start, then the smaller period."""
    x, y = (p["length"].cast("decimal(19,0)") * o["period"].cast("decimal(19,0)") for p, o in ((a, b), (b, a)))
    first = F.when(x > y, -1).when(x < y, 1)
    for k in ("start", "period"):
        first = first.when(a[k] < b[k], -1).when(a[k] > b[k], 1)
    return first.otherwise(0)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods, and sha256 of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = F.try_element_at(F.array_sort("runs", _more_periods), F.lit(1))
    out = found.withColumn("top", top)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
