"""The audit of filters against counting row by row, in every order."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, n int, kept string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    texts = [t or "" for _, t, _ in rows]
    out = []
    for (i, _, _), t in zip(rows, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append(f + "E" * (i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, texts))))
    return out


def brute(rows, labels):
    out, f = {}, fails(rows)
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, x) for (i, _, s), x in zip(rows, f) if (s or "") == part]
        good = {i for i, q, _, _ in labels if q == 1 and i is not None}
        toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                here = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                total[c] += len(here)
                redundant = sum(c in x for _, x in mine) - len(here)
                out[part, "".join(order), k + 1] = [len(left), len(here), redundant, sum(x == c for _, x in mine), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), c]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return out


def table(seed):
    rng = random.Random(seed)
    vocab = ["one", "Two", "THREE", "f#ur", "five", "six\x0bseven", "é日", "𝄞"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \t\r\n", "A", "word " * 3000, "\x85a b", "x$"] + [" ".join(rng.choices(vocab, k=rng.choice([3, 49, 50, 51, 70]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(5, "the same", "a")] * 3 + [(i, "hot text", "a") for i in range(100, 160)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "x") for _ in range(50)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_is_counted_as_by_hand(spark, seed):
    rows, labels = table(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    mine = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}
    assert len(got) == len(mine) and mine == brute(rows, labels)


def test_texts_decide_where_hashes_are_alike(spark):
    rows, labels = table(3)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    weak = filter_audit.combinations(docs, spark.createDataFrame(labels, LABELS), digest=lambda t: F.encode(F.substring(t, 1, 1), "utf-8"))
    strong = filter_audit.combinations(docs, spark.createDataFrame(labels, LABELS))
    # The hash also tells apart rows of one doc_id; compare where no doc_id stands twice with another text.
    assert weak.agg(F.sum("n")).first()[0] == strong.agg(F.sum("n")).first()[0] == len(rows)
    once = [r for k, r in {r[0]: r for r in rows if r[0] is not None}.items()]
    docs = spark.createDataFrame([(*r, 1, "x") for r in once], SCHEMA)
    both = [sorted(map(tuple, filter_audit.combinations(docs, spark.createDataFrame(labels, LABELS), digest=d).collect())) for d in (lambda t: F.encode(F.substring(t, 1, 1), "utf-8"), filter_audit._digest)]
    assert both[0] == both[1]


def test_empty_tables(spark):
    rows, _ = table(4)
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).count() == 0
    r = filter_audit.audit(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), no_labels)
    assert r.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)
