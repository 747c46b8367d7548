"""Runs against every start, length and period tried by hand."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from marlstone.llm import periodic
from marlstone.llm.queries import planted


def brute(words):
    """(start, length, period) from each period's stretches of equal words; the smallest period of an interval counts."""
    best = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        s = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and s is None:
                s = i
            if not same and s is not None:
                if i - s + q >= max(24, 3 * q):
                    best.setdefault((s, i - s + q), q)
                s = None
    return sorted((s, k, q) for (s, k), q in best.items())


def collapsed(words, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return [w for i, w in enumerate(words) if i not in gone]


def local(words):
    """Runs by tiles, stitched in Python."""
    known = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
    parts = {}
    for lo, hi, base, first, last, part in periodic.tiles(codes):
        for q, s, e in periodic.solve(part, base, first, last, lo, hi):
            parts.setdefault(q, []).append((s, e))
    out = []
    for q, spans in parts.items():
        whole = []
        for s, e in sorted(spans):
            if whole and s <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], e)
            else:
                whole.append([s, e])
        out += [(s, e - s + q, q) for s, e in whole if e - s + q >= max(24, 3 * q)]
    return sorted(out)


def samples(rng):
    yield []
    yield ["a"] * 23
    yield ["a"] * 24
    yield ["a", "b"] * 12
    yield ["a", "b"] * 12 + ["a"] + ["c"] * 30
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.5:
                unit = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 32, 33, 50]))]
                k = rng.randint(1, 4 * len(unit) + 30)
                words += (unit * (k // len(unit) + 1))[:k]
            else:
                words += [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, 90))]
        yield words


@pytest.mark.parametrize("tile", [64, periodic.TILE])
def test_tiles_find_every_run(monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE", tile)
    for words in samples(random.Random(5)):
        assert local(words) == brute(words), words


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randint(0, 1) for _ in range(rng.randint(1, 30))]
        assert periodic.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_long_texts_take_linear_time():
    import time

    x = [str(i % 7) for i in range(60_000)]
    t = time.time()
    assert local(x) == [(0, 60_000, 7)]
    unit = [str(k) for k in range(9_000)]
    assert local(unit * 5 + ["x"]) == [(0, 45_000, 9_000)]
    assert time.time() - t < 30


def test_query_and_odd_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "x " * 5000, "a\x85b " * 40, "é日 𝄞 " * 30, "tie b " * 20 + "z " + "c d " * 20]
    texts += ["\n".join(" ".join(rng.choices(["a", "b", "c", "d\x1c"], k=rng.randint(1, 9))) * rng.randint(1, 5) for _ in range(rng.randint(1, 20))) for _ in range(30)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(i, texts[i], 1, 2) for i in (4, 4, 7)] + [(None, texts[4], 1, 2), (4, texts[7], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, runs int")
    want, whole = [], []
    for i, t, _, _ in rows:
        w = planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        runs = brute(w)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        text = " ".join(collapsed(w, runs))
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(text)))
        whole.append((i, len(w), runs, text))
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    got = [tuple(r) for r in periodic.digest(periodic.find(docs, texts=False, change=planted)).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    full = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find(docs, change=planted).collect()]
    assert sorted(full, key=order) == sorted(whole, key=order)
    assert periodic.digest(periodic.find(docs.limit(0))).count() == 0


def test_planted_words_repeat():
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [str(k) for k in range(200)]
    got = planted(doc, words)
    g = zlib.crc32(str(doc).encode()) // 10
    a = g % 200
    p = 1 + (200 - a) // (3 + g % 8)
    assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(200)] and planted(None, words) == words
