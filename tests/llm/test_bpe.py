"""Merges by a segment tree against plain merging and against the library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe
from marlstone.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "'s", "'", "b1", "é", "日本", "<|endoftext|>", "<|endof", "　", "\x85", "\x1c", "𝄞", "!", "--", "\r\n", "don't", "́", "x" * 30, "՘", "\U00018d10", "١", "½"]
ODD = [None, "", " ", "  ", "\n \n", "a", " lead", "trail ", "double  space", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "﻿é日 𝄞", "tie tie tie", "aaaa" * 5000, "word " * 5000]


@pytest.fixture(scope="module")
def both():
    return bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)


def plain_merge(ids, ranks, made, base):
    ids = list(ids)
    while True:
        found = [(ranks[a * base + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a * base + b in ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [made[rank]]


def test_the_root_is_the_leftmost_lowest_rank():
    rng = random.Random(4)
    for _ in range(2000):
        base, pairs = 40, rng.sample(range(30 * 30), 25)
        ranks = {(p // 30) * base + p % 30: k for k, p in enumerate(pairs)}
        made = [rng.randrange(30) for _ in pairs[:-1]] + [35]
        ids = [rng.choice([p // 30 for p in pairs] + [p % 30 for p in pairs]) for _ in range(rng.randint(0, 12))]
        # Ids grow with ranks in real tables; here a merge may make a pair of any rank, so loops end by length.
        assert bpe.merge(list(ids), ranks, made, base) == plain_merge(ids, ranks, made, base)


def test_ids_and_texts_are_the_library_s(both):
    v, tk = both
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) for _ in range(4000)] + [t for t in ODD if t]
    for t, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False)):
        ids = v.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert v.decode(ids) == tk.decode(e.ids, skip_special_tokens=False)
    for _ in range(2000):  # ids of no text: bytes that are no UTF-8
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 6))]
        assert v.decode(np.array(ids, "<u4").tobytes()) == tk.decode(ids, skip_special_tokens=False)
    assert v.decode(np.array([5, 99_999_999], "<u4").tobytes()) == v.decode(np.array([5], "<u4").tobytes())


def test_every_character_is_cut_as_the_library_does(both):
    v, tk = both
    step = range(0, 0x110000, 1)
    chars = [chr(c) for c in step if not 0xD800 <= c < 0xE000 and (c < 0x3100 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x20000 and c % 3 == 0)]
    texts = [f"a{c}1 {c}!{c} \n{c}" for c in chars]
    assert [v.encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_words_is_bounded():
    v = bpe.Vocabulary(PATH, remembered=50)
    fresh = bpe.Vocabulary(PATH)
    for k in range(40):
        t = " ".join(f"word{k}x{j}" for j in range(30))
        assert v.encode(t) == fresh.encode(t)
    assert len(v.words) < 100 and len(v.known) < 100


def test_query_on_odd_rows(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)] + [(3, "again", 7, "x"), (3, "again", 7, "x"), (None, "no id", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    tk = Tokenizer.from_file(PATH)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _, _ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tk.decode(ids, skip_special_tokens=False).encode())))
    got = [(r["doc_id"], r["n_tokens"], sha(bytes(r["ids"])), sha(r["text"].encode())) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_other_formats_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(tokenizer_path("word_bpe_49k.json"))
