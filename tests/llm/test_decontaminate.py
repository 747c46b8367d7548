"""Decontamination at shard ends, with shared windows, and its longest matches against brute force."""

import collections
import hashlib
import random

from marlstone.llm import decontaminate
from tests.llm.test_corpus import ODD, docs, words


def longest_by_hand(w, items):
    """The longest run of words that an item holds too, if it is of a window (or a whole short item)."""
    best = None
    for name, text in items:
        v = words(text)
        need = min(13, len(v))
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n and n >= need:
                    best = min(best or (1,), (-n, i, name, j))
    return (-best[0], *best[1:]) if best else (0, None, None, None)


def test_shard_ends_and_long_texts(spark):
    b = spark.createDataFrame([("i", "a b c"), ("long", "w" + " w" * 30)], "item_id string, text string")
    texts = ["a b c d", "x a b c", None, "", "w " * 1000, "q"]
    want = [(4, 3, True), (4, 3, True), (0, 0, False), (0, 0, False), (1000, 1000, True), (1, 0, False)]
    for limit in (1, 5, 8, 10, 1001, 10**6):  # with 5, 8 and 10 a row of a batch just closes a shard
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.scan(docs(spark, texts).coalesce(1), b, shard_words=limit).collect()}
        assert [got[i] for i in range(len(texts))] == want
        left = decontaminate.remove(docs(spark, texts).coalesce(1), b, shard_words=limit)
        assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5]
    assert decontaminate.scan(docs(spark, ["a b c"] * 2), b, shard_words=4).count() == 2


def test_a_window_that_many_items_share(spark):
    items = [(f"{i:04d}", "same words") for i in range(3000)] + [("other", "same words and more")]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.scan(docs(spark, ["same words " * 3000, "no"]), b, longest_match=True).orderBy("doc_id").collect()
    names = sorted(i for i, _ in items[:3000])
    assert (got[0]["n_hit"], got[0]["n_items"]) == (6000, 3000)
    assert got[0]["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert (got[0]["longest_words"], got[0]["longest_at"], got[0]["longest_item"]) == (2, 0, "0000") and got[1]["n_items"] == 0


def test_longest_matches_are_those_of_brute_force(spark):
    rng = random.Random(9)
    long = [rng.choice("abcd") for _ in range(60)]
    items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))) for i in range(12)] + [("L", " ".join(long)), ("M", " ".join(long[5:50])), ("0", "z z"), ("n", None)]
    texts = [" ".join(rng.choice("abz") for _ in range(rng.randint(0, 50))) for _ in range(40)]
    texts += ["x " + " ".join(long[k : k + n]) + " y " + " ".join(long[2:20]) for k, n in ((0, 60), (3, 30), (10, 13), (20, 12))] + ODD[:6]
    b = spark.createDataFrame(items, "item_id string, text string")
    known = collections.OrderedDict((i, t) for i, t in items if t)
    for chars in (10**6, 150):
        got = {r["doc_id"]: (r["longest_words"], r["longest_at"], r["longest_item"], r["longest_item_word"]) for r in decontaminate.scan(docs(spark, texts), b, max_chars=chars, shard_words=200, longest_match=True).collect()}
        for i, t in enumerate(texts):
            assert got[i] == longest_by_hand(words(t), known.items()), (i, t)
    m = {r["doc_id"]: r["n_words"] for r in decontaminate.matches(docs(spark, texts), b).collect()}
    assert m == {i: g[0] for i, g in got.items() if g[0]}
