"""Canonical length-limited Huffman coding of ids, in numpy.

Code lengths come from counts by package-merge; codes are canonical, so that
the lengths alone tell them. Ids are coded in blocks of equally many ids; the
bit offset where each block begins is a checkpoint from which it can be
decoded on its own. Decoding looks up as many bits as the longest code has in
one table, and decodes all blocks of a call side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = 18
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best codes of at most ``limit`` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    m = len(used)
    if m == 0:
        return out
    if m == 1:
        out[used] = 1
        return out
    if m > 1 << limit:
        raise ValueError(f"{m} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")  # leaves before packages of the same weight
        levels.append(place < m)
        both = both[place]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (m - 1)
    lengths = np.zeros(m, np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        n = lengths[order].astype(np.int64)
        top = int(n.max())
        space = np.concatenate([[0], np.cumsum(1 << (top - n))[:-1]])
        codes[order] = (space >> (top - n)).astype(np.uint64)
    return codes


@dataclass
class Code:
    lengths: np.ndarray

    def __post_init__(self):
        self.codes = canonical(self.lengths)
        self.top = max(1, int(self.lengths.max(initial=0)))
        self._table = None

    def table(self) -> np.ndarray:
        """For each run of ``top`` bits the id it begins with, and in the last byte its length."""
        if self._table is None:
            t = np.zeros(1 << self.top, np.uint32)
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            n = self.lengths[order].astype(np.int64)
            filled = np.repeat((order.astype(np.uint32) << np.uint32(8)) | n.astype(np.uint32), 1 << (self.top - n))
            t[: len(filled)] = filled
            self._table = t
        return self._table

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bits, padded to 32, and the bit offset of every block."""
        bits, marks = self.encode_many(ids, np.array([len(ids)]), block)
        return bits[0], np.frombuffer(marks[0], np.uint32)

    def encode_many(self, ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[bytes]]:
        """Per run of ``sizes`` ids its bits, padded to 32, and its blocks' bit offsets as u32."""
        used = np.asarray(sizes, np.int64)
        last = np.cumsum(used)
        first_id = last - used
        n = self.lengths[ids].astype(np.int64)
        if not n.all():
            raise ValueError("an id has no code")
        end = np.concatenate([[0], np.cumsum(n)])
        words = -(-(end[last] - end[first_id]) // 32)
        begin = np.cumsum(words) - words  # every run begins a word
        within = end[:-1] - np.repeat(end[first_id], used)
        start = within + np.repeat(begin * 32, used)
        word = start >> 5
        wide = self.codes[ids] << (64 - n - (start & 31)).astype(np.uint64)
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        if len(ids):
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            w = word[at]
            out[w] += np.add.reduceat(wide >> np.uint64(32), at)
            out[w + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), at)
        data, marks = out.astype(">u4").tobytes(), within.astype("<u4")
        bits = [data[4 * b : 4 * (b + w)] for b, w in zip(begin.tolist(), words.tolist())]
        return bits, [marks[a:z:block].tobytes() for a, z in zip(first_id.tolist(), last.tolist())]

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the blocks that begin at bit ``starts`` and have ``counts`` ids, one after the other."""
        total = int(counts.sum())
        if not total:
            return np.zeros(0, np.uint32)
        words = np.zeros(len(data) // 4 + 2, np.uint64)
        words[:-2] = np.frombuffer(data, ">u4")
        pair = (words[:-1] << np.uint64(32)) | words[1:]
        table, mask, top = self.table(), np.uint64((1 << self.top) - 1), 64 - self.top
        order = np.argsort(-counts, kind="stable")
        off, left = starts[order].astype(np.int64), counts[order].astype(np.int64)
        begin = (np.cumsum(counts) - counts)[order]
        out = np.zeros(total, np.uint32)
        live = len(order)
        for k in range(int(left[0])):
            while left[live - 1] <= k:  # longest first: what has ended is at the end
                live = int(np.searchsorted(-left, -k, side="left"))
            o = off[:live]
            bits = (pair[o >> 5] >> (top - (o & 31)).astype(np.uint64)) & mask
            found = table[bits]
            out[begin[:live] + k] = found >> np.uint32(8)
            off[:live] = o + (found & np.uint32(0xFF))
        return out
