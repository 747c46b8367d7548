"""Byte-level pair merging with a segment tree, and back.

A piece of text is its bytes at first. A leaf of the tree stands for each pair
of neighbours and holds the pair's rank and place; an inner node holds the
least of its (sixteen) children, so that the root is the leftmost of the pairs
with the lowest rank. A merge changes three leaves and what is above them. It
ends when no pair in the tree can be merged.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: How texts are cut into pieces (letters, numbers); fixed, it goes with the vocabulary's format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Longer words are not remembered.
LONG_WORD = 64


def byte_signs() -> list[str]:
    """The character that stands for each byte in the vocabulary's format: itself, if it can be seen in Latin-1, else one from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


def _pattern(letters: str = r"\p{L}", numbers: str = r"\p{N}") -> regex.Pattern:
    return regex.compile(PIECES.replace("{L}", letters).replace("{N}", numbers), regex.V1)


@functools.cache
def late_signs() -> tuple[frozenset[str], regex.Pattern]:
    """Letters and numbers of ``regex`` that the tokenizers library's version of Unicode lacks, and the pattern without them.

    The library itself says which, once in a process. The pattern with sets
    taken from sets is slow: only texts that hold such a character need it.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    late = {}
    for kind, sign in (("L", "a"), ("N", "1")):
        known = regex.findall(rf"\p{{{kind}}}", every)
        pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f" {sign}{c}" for c in known))
        # A piece that ends after the sign doesn't take the character in.
        ends = {end for _, (_, end) in pieces}
        late[kind] = "".join(c for k, c in enumerate(known) if 3 * k + 2 in ends)
    sets = [rf"[\p{{{k}}}--[{late[k]}]]" if late[k] else rf"\p{{{k}}}" for k in "LN"]
    return frozenset(late["L"] + late["N"]), _pattern(*sets)


#: Children of a node of the tree, as a power of two.
FAN = 4


def merge(ids: list[int], ranks: dict[int, int], made: list[int], base: int) -> list[int]:
    """``ids`` after all merges; ``ranks`` has a pair's rank by first * base + second, ``made`` the id that a rank makes."""
    n = len(ids)
    if n < 2:
        return ids
    get, miss = ranks.get, len(made)
    none = miss * n  # no rank: more than any leaf that has one
    leaves = [get(a * base + b, miss) * n + i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    levels = [leaves]
    while len(levels[-1]) > 1 << FAN:
        below = levels[-1]
        levels.append([min(below[k : k + (1 << FAN)]) for k in range(0, len(below), 1 << FAN)])
    top, deep = levels[-1], len(levels) > 1
    after = before = None
    while (root := min(top)) < none:
        if after is None:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, i = divmod(root, n)
        j = after[i]
        new = ids[i] = made[rank]
        ids[j] = -1
        k = after[i] = after[j]
        p = before[i]
        if k < n:
            before[k] = i
            leaves[i] = get(new * base + ids[k], miss) * n + i
            leaves[j] = none
        else:  # the second of the pair was the last: no pair begins there
            leaves[i] = none
        if p >= 0:
            leaves[p] = get(ids[p] * base + new, miss) * n + p
        if deep:
            for at in (i, j if k < n else i, p if p >= 0 else i):
                for below, level in zip(levels, levels[1:]):
                    at >>= FAN
                    least = min(below[at << FAN : (at + 1) << FAN])
                    if level[at] == least:
                        break
                    level[at] = least
    return ids if after is None else [x for x in ids if x >= 0]


class Vocabulary:
    """A byte-level vocabulary and its merges, from a file in the tokenizers library's format."""

    def __init__(self, path: str, remembered: int = 600_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = not file.get("normalizer") and not file.get("post_processor") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (file.get("decoder") or {}).get("type") != "ByteLevel" or not plain:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        vocab, signs = model["vocab"], byte_signs()
        self.base = max(vocab.values()) + 1
        self.first = [vocab[s] for s in signs]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[vocab[a] * self.base + vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        added = file.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"tokens that take what is beside them: {path}")
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        of = {s: b for b, s in enumerate(signs)}
        #: The bytes of every id; an id that is nobody's has none.
        self.bytes: list[bytes] = [b""] * (max([self.base - 1, *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.bytes[i] = bytes(of[c] for c in s) if all(c in of for c in s) else s.encode()
        self.pieces = _pattern()
        self.late, self.careful = late_signs()
        self.blank = regex.compile(r"\s ")
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.bound = remembered

    def piece(self, piece: str) -> bytes:
        first = self.first
        return array("I", merge([first[b] for b in piece.encode()], self.ranks, self.made, self.base)).tobytes()

    def cut(self, text: str) -> bytes:
        """Ids of a text without special tokens, cut into pieces."""
        pieces = self.pieces if text.isascii() or self.late.isdisjoint(text) else self.careful
        out = []
        for p in pieces.findall(text):
            found = self.known.get(p)
            if found is None:
                found = self.piece(p)
                if len(p) <= LONG_WORD:
                    self.known[p] = found
            out.append(found)
        return b"".join(out)

    def forget(self) -> None:
        """Keep both memories within their bound; what came first is what is frequent."""
        if len(self.words) > self.bound:
            self.words = dict(islice(self.words.items(), self.bound // 2))
        if len(self.known) > self.bound:
            self.known = dict(islice(self.known.items(), self.bound // 2))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, little-endian, four bytes each.

        Between a character that is no space and a space pieces always part,
        and nothing before that place changes what follows it. So words with
        the space before them, and stretches of white space with the word
        after them, are looked up as a whole.
        """
        if self.blank.search(text):
            # White space before a space: each stretch goes with what is after it.
            units = regex.findall(r"\s*\S+|\s+", text)
        else:
            units = [" " + w for w in text.split(" ")]
            units[0] = units[0][1:]
        self.forget()
        words = self.words
        out = []
        for u in units:
            found = words.get(u)
            if found is None:
                found = self.cut(u)
                if len(u) <= LONG_WORD:
                    words[u] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.parts is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.plain(p) for p in self.parts.split(text) if p)

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        found = np.frombuffer(ids, "<u4").tolist()
        try:
            data = b"".join([table[i] for i in found])
        except IndexError:
            data = b"".join([table[i] for i in found if i < len(table)])
        return data.decode("utf-8", "replace")


_OPENED: dict[str, Vocabulary] = {}


def opened(path: str) -> Vocabulary:
    """The vocabulary of this Python process, read once."""
    if path not in _OPENED:
        _OPENED[path] = Vocabulary(path)
    return _OPENED[path]


def encode(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian, four bytes each) of every whole text.

    The ids are those of the tokenizers library with the vocabulary in the
    file ``path``, which each machine has, without added special tokens;
    strings of special tokens in a text are those tokens. Each row is worked
    on by itself: rows may repeat or lack a doc_id. A null or empty text has
    no ids; an empty table gives no rows; further columns, of any name, are
    ignored. A piece of n bytes takes time in n * log n, whatever it holds, so
    a very long word does no harm. Up to 600,000 short words and as many
    pieces are remembered in a Python process, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(path)
        for b in slices(batches):
            ids = [v.encode(t) if t else b"" for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` (doc_id, n_tokens, ids) and text: the bytes of all ids, special ones too.

    Bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks are
    left out, as the library does; no ids, or null, give the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(path)
        for b in slices(batches):
            texts = pa.array([v.decode(i) if i else "" for i in b["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
