"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a bounded run of documents as word numbers in the benchmark's
vocabulary (0 for other words and between documents). Its suffix array holds
the positions from which enough benchmark words follow one another to fill a
window, sorted by the words that follow. Every suffix of every test item is
looked up by binary search: the range it finds are all places where its first
window stands. Places are then widened to the longest verbatim matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop, lean, written

WORDS = re.compile(WORD)
WINDOW = 13


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


@dataclass
class TestSuffixes:
    """The distinct windows of a block of test items, and all their suffixes.

    items: item ids as text, sorted. stream: the items' word numbers, each
    item ended by 0. size, low, high: of each distinct window its number of
    words and the bounds of its key, in words of 64 bits. first, held: where a
    window's items begin in the list of items by window. order: the stream's
    places, sorted by the words that follow. item_at, word_at: a place's item
    and its word in the item.
    """

    vocab: dict[str, int]
    items: list[str]
    stream: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    held: np.ndarray
    order: np.ndarray
    item_at: np.ndarray
    word_at: np.ndarray
    bits: int


def _keys(stream: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int, bits: int, pad: int = 0) -> np.ndarray:
    """(n, words) keys of the suffixes at ``at``, in order; beyond ``room`` words stands ``pad``."""
    per = 64 // bits
    out = np.zeros((len(at), -(-depth // per)), np.uint64)
    for k in range(depth):
        inside = k < room
        word = np.where(inside, stream[np.minimum(at + k, len(stream) - 1)], pad).astype(np.uint64)
        out[:, k // per] |= word << np.uint64(bits * (per - 1 - k % per))
    return out


def _run_lengths(stream: np.ndarray) -> np.ndarray:
    """How many words of the vocabulary follow one another from each position."""
    at = np.arange(len(stream), dtype=np.int64)
    stop = np.where(stream == 0, at, len(stream))
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def _suffix_order(stream: np.ndarray, depth: int) -> np.ndarray:
    """Places of the stream sorted by the ``depth`` words or more that follow, by doubling what is compared."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    done = 1
    while True:
        after = np.zeros(len(rank), np.int64)
        if done < len(rank):
            after[:-done] = rank[done:] + 1
        both = rank * (len(rank) + 2) + after
        order = np.argsort(both, kind="stable")
        if done >= depth:
            return order
        step = np.concatenate([[0], both[order][1:] != both[order][:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step)
        done *= 2


def test_suffixes(items: list[tuple[str, str | None]], window: int = WINDOW) -> TestSuffixes:
    vocab: dict[str, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    parts, at, item, size, item_at, word_at, base, longest_item = [], [], [], [], [], [], 0, 1
    for name, text in sorted(items, key=lambda i: (i[0], i[1] or "")):
        words = words_of(text)
        if not words:
            continue
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        n = min(window, len(ids))
        starts = np.arange(len(ids) - n + 1)
        at.append(base + starts)
        item.append(np.full(len(starts), number[name]))
        size.append(np.full(len(starts), n))
        item_at.append(np.full(len(ids) + 1, number[name]))
        word_at.append(np.arange(len(ids) + 1))
        parts.append(np.array([*ids, 0], np.int32))
        base += len(ids) + 1
        longest_item = max(longest_item, len(ids))
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    stream = np.concatenate(parts) if parts else np.zeros(1, np.int32)
    bits = max(1, (len(vocab) + 1).bit_length())
    a, s, i = cat(at), cat(size), cat(item)
    low = _keys(stream, a, s, window, bits)
    # Windows that items share stand once, each with the list of its items.
    whole = np.column_stack([s.astype(np.uint64), low])
    _, one, window_of = np.unique(whole, axis=0, return_index=True, return_inverse=True) if len(a) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = np.unique(np.column_stack([window_of.ravel(), i]), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
    return TestSuffixes(
        vocab, names, stream, s[one], low[one], _keys(stream, a[one], s[one], window, bits, (1 << bits) - 1),
        first, pairs[:, 1].astype(np.int32), _suffix_order(stream, longest_item), cat(item_at) if parts else np.zeros(1, np.int64), cat(word_at) if parts else np.zeros(1, np.int64), bits,
    )


def _bound(keys: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """First place in the sorted keys that isn't below ``want`` (``after``: that is above it)."""
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(keys), np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        probe = keys[np.minimum(mid, len(keys) - 1)]
        below, equal = np.zeros(len(want), bool), np.ones(len(want), bool)
        for k in range(keys.shape[1]):
            below |= equal & (probe[:, k] < want[:, k])
            equal &= probe[:, k] == want[:, k]
        go = open_ & (below | equal if after else below)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def shard_matches(stream: np.ndarray, test: TestSuffixes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every place in the shard where a test window stands; one entry for a place and size."""
    none = np.zeros(0, np.int64)
    if not len(test.size):
        return none, none
    run = _run_lengths(stream)
    at = np.flatnonzero(run >= test.size.min())
    if not len(at):
        return none, none
    keys = _keys(stream, at, run[at], window, test.bits)
    order = np.lexsort(keys.T[::-1])
    at, keys = at[order], keys[order]  # the suffix array
    lo, hi = _bound(keys, test.low, False), _bound(keys, test.high, True)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _compare(stream: np.ndarray, at: np.ndarray, test: TestSuffixes, place: np.ndarray, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """How many words the shard's suffixes at ``at`` share with the test suffixes at ``place``, and which of these are less."""
    shared, less = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    todo = np.arange(len(at))
    offset = np.arange(step)
    while len(todo):
        s, t = at[todo] + shared[todo], place[todo] + shared[todo]
        mine = np.where(s[:, None] + offset < len(stream), stream[np.minimum(s[:, None] + offset, len(stream) - 1)], 0)
        theirs = np.where(t[:, None] + offset < len(test.stream), test.stream[np.minimum(t[:, None] + offset, len(test.stream) - 1)], 0)
        # A 0 ends both: no match goes over it.
        differ = (mine != theirs) | (mine == 0)
        stop = differ.any(axis=1)
        k = np.where(stop, differ.argmax(axis=1), step)
        shared[todo] += k
        row = np.arange(len(todo))[stop]
        less[todo[stop]] = theirs[row, k[stop]] < mine[row, k[stop]]
        todo = todo[~stop]
    return shared, less


def longest_from(stream: np.ndarray, at: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(words, rank): of each shard position the longest run of words that some test item holds, and where it stands in the order of test suffixes."""
    n = len(test.order)
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    best, rank = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return best, rank
        mid = (lo[open_] + hi[open_]) // 2
        shared, less = _compare(stream, at[open_], test, test.order[mid])
        better = shared > best[open_]  # the neighbours of the place looked for are among those probed
        best[open_[better]], rank[open_[better]] = shared[better], mid[better]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def _first_item(test: TestSuffixes, rank: int, words: int) -> tuple[int, int]:
    """(item, word): of all test places with the same ``words`` words as the suffix of this rank the first, by item and word."""
    want = test.stream[test.order[rank] : test.order[rank] + words]

    def same(k: int) -> bool:
        return bool(np.array_equal(test.stream[test.order[k] : test.order[k] + words], want))

    def edge(step: int) -> int:
        near, far = 0, 1  # near is inside the run of equal suffixes; far is looked for outside it
        while 0 <= rank + step * far < len(test.order) and same(rank + step * far):
            near, far = far, far * 2
        while far - near > 1:
            mid = (near + far) // 2
            k = rank + step * mid
            near, far = (mid, far) if 0 <= k < len(test.order) and same(k) else (near, mid)
        return rank + step * near

    places = test.order[edge(-1) : edge(1) + 1]
    k = np.lexsort((test.word_at[places], test.item_at[places]))[0]
    return int(test.item_at[places[k]]), int(test.word_at[places[k]])


#: The longest match of a document: words, its first word in the document, item, its first word in the item.
Match = tuple[int, int, str, int]


def longest(which: np.ndarray, pos: np.ndarray, stream: np.ndarray, begins: np.ndarray, test: TestSuffixes, window: int = WINDOW) -> dict[int, Match]:
    """Per document of the shard its longest verbatim match of a window or more; of equally long ones the first, then the first item.

    ``begins``: where documents begin in the shard.
    """
    at = np.unique(pos)
    if not len(at):
        return {}
    largest, words_at = np.zeros(len(at), np.int64), np.searchsorted(at, pos)
    np.maximum.at(largest, words_at, test.size[which])
    long, rank = longest_from(stream, at, test)
    # A match shorter than a full window counts as far as a whole short item reaches.
    size = np.where(long >= window, long, largest)
    doc = np.searchsorted(begins, at, side="right") - 1
    out: dict[int, Match] = {}
    order = np.lexsort((at, -size, doc))
    for k in order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]:
        if long[k] >= window:
            item, word = _first_item(test, int(rank[k]), int(size[k]))
        else:
            w = which[(pos == at[k]) & (test.size[which] == size[k])][0]
            item, word = int(test.held[test.first[w]]), 0
        out[int(doc[k])] = (int(size[k]), int(at[k] - begins[doc[k]]), test.items[item], word)
    return out


def _shards(batches: Iterator[pd.DataFrame], test: TestSuffixes, limit: int):
    """Bounded runs of rows, never empty: the batch, its rows, and their word numbers, each row's ended by 0."""
    get = test.vocab.get
    for b in batches:
        rows, parts, held = [], [], 0
        for r, text in enumerate(b["text"]):
            words = words_of(text) if isinstance(text, str) else []
            ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
            rows.append(r)
            parts += [ids, np.zeros(1, np.int32)]
            held += len(ids) + 1
            if held >= limit:
                yield b, rows, parts
                rows, parts, held = [], [], 0
        if rows:
            yield b, rows, parts


def _scan(shared, limit: int, window: int, first: bool, last: bool, widen: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test: TestSuffixes = shared.value
        digests: dict[tuple[str, ...], str] = {}

        def digest(names: list[str]) -> str:
            key = tuple(names)
            if key not in digests:
                if len(digests) >= 1000:
                    digests.clear()
                digests[key] = hashlib.sha256(",".join(names).encode("utf-8", "replace")).hexdigest()
            return digests[key]

        for b, rows, parts in _shards(batches, test, limit):
            sizes = np.array([len(p) for p in parts[::2]], np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            stream = np.concatenate(parts)
            which, pos = shard_matches(stream, test, window)
            diff = np.zeros(len(stream) + 1, np.int64)
            np.add.at(diff, pos, 1)
            np.add.at(diff, pos + test.size[which], -1)
            hit = np.cumsum(diff[:-1]) > 0
            doc = np.searchsorted(begins, pos, side="right") - 1
            seen = np.unique(np.column_stack([doc, which]), axis=0)  # each distinct window of a document once
            ends = np.searchsorted(seen[:, 0], np.arange(len(rows) + 1))
            best = longest(which, pos, stream, begins, test, window) if widen else {}
            hits, items, tops = [], [], []
            for k, r in enumerate(rows):
                h = hit[begins[k] : begins[k] + sizes[k]]
                mine = seen[ends[k] : ends[k + 1], 1]
                found = [test.items[i] for i in np.unique(np.concatenate([test.held[test.first[w] : test.first[w + 1]] for w in mine]))] if len(mine) else []
                top = best.get(k, NO_MATCH)
                if not first:  # what the blocks of items before this one gave
                    if (old := b["hits"].iloc[r]) is not None and len(old):
                        h = h | np.unpackbits(np.frombuffer(old, np.uint8), count=len(h)).astype(bool)
                    found = sorted({*found, *b["items"].iloc[r]})
                    old = (int(b["m_words"].iloc[r]), int(b["m_at"].iloc[r]), b["m_item"].iloc[r], int(b["m_from"].iloc[r]))
                    top = min((m for m in (top, old) if m[0]), key=lambda m: (-m[0], m[1], m[2], m[3]), default=NO_MATCH)
                hits.append(h)
                items.append(found)
                tops.append(top)
            out = b.iloc[rows].drop(columns=[c for c in ("text", "hits", "items", "m_words", "m_at", "m_item", "m_from") if c in b and (last or c != "text")])
            text = lambda values: pd.Series(values, index=out.index, dtype=object)
            if last:
                n_hit = np.array([h.sum() for h in hits], np.int64)
                out["n_words"], out["n_hit"], out["n_items"] = sizes, n_hit, np.array([len(i) for i in items], np.int64)
                out["items_sha256"] = text([digest(i) for i in items])
                out["contaminated"] = (n_hit > 0) & (20 * n_hit >= sizes)
                if not widen:
                    yield out
                    continue
                none = [t[0] == 0 for t in tops]
                out["longest_words"] = np.array([t[0] for t in tops], np.int64)
                out["longest_at"] = pd.Series([t[1] for t in tops], index=out.index, dtype="Int64").mask(none)
                out["longest_item"] = text([t[2] if t[0] else None for t in tops])
                out["longest_item_word"] = pd.Series([t[3] for t in tops], index=out.index, dtype="Int64").mask(none)
            else:
                out["hits"] = text([np.packbits(h).tobytes() if h.any() else None for h in hits])
                out["items"] = text(items)
                for c, j in (("m_words", 0), ("m_at", 1), ("m_from", 3)):
                    out[c] = np.array([t[j] for t in tops], np.int64)
                out["m_item"] = text([t[2] for t in tops])
            yield out

    return run


NO_MATCH: Match = (0, 0, "", 0)


def item_blocks(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of about ``max_chars`` characters; the driver holds one block at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // max_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.distinct().collect()]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
WIDENED = ", longest_words long, longest_at long, longest_item string, longest_item_word long"
BETWEEN = "text string, hits binary, items array<string>, m_words long, m_at long, m_from long, m_item string"


def scan(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, max_chars: int = 16_000_000, shard_words: int = 500_000, longest_match: bool = False) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    ``keep`` columns must not have the results' names. With ``longest_match``
    four columns follow: longest_words is the
    length of the longest verbatim run of words, of a window or more, that a
    test item holds too; longest_at, longest_item and longest_item_word tell
    where it stands (of equally long ones the first in the document, then the
    least item, then the first in it; null if there is none).

    A document without words, or null, has zeros and isn't contaminated. Items
    without words match nothing; an item id that is repeated counts once, with
    the windows of all its rows. An empty benchmark gives zeros. Repeated
    documents each give a row.

    Items are shared with the tasks in blocks of at most ``max_chars``
    characters, one pass over the documents for each block, whose results are
    written before the next one is sent; a shard is of ``shard_words`` words
    and at least one document.
    """
    sc = docs.sparkSession.sparkContext
    df = docs.select(*keep, "text")
    base = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    blocks = item_blocks(benchmark, max_chars)
    block, used, k = next(blocks), None, 0
    while block is not None:
        after = next(blocks, None)
        shared = sc.broadcast(test_suffixes(block, window))
        new = df.mapInPandas(lean(_scan(shared, shard_words, window, k == 0, after is None, longest_match)), f"{base}, {BETWEEN if after is not None else RESULT + WIDENED * longest_match}")
        if after is not None:
            new, path = written(new)
            shared.destroy()
            if used:
                drop(docs.sparkSession, used)
            used = path
        df, block, k = new, after, k + 1
    return df


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: the longest verbatim match of each document that has one."""
    found = scan(docs, benchmark, longest_match=True, **options).where("longest_words > 0")
    return found.select("doc_id", F.col("longest_item").alias("item_id"), F.col("longest_at").alias("doc_word"), F.col("longest_item_word").alias("item_word"), F.col("longest_words").alias("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns, whatever their names."""
    own = {c: f"__k{i}" for i, c in enumerate(docs.columns)}
    marked = scan(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], F.col("text")), benchmark, keep=tuple(own.values()), **options)
    return marked.where("NOT contaminated").select(*[F.col(k).alias(c) for c, k in own.items()])
