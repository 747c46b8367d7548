"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation is the one whose pieces' scores have the largest sum.
The search goes through the text once and keeps a window of states that is
bounded by the longest piece. Whenever all backpointer paths that can still
be continued pass one boundary, the ids before it are committed and
forgotten. Characters that no piece covers are written as byte pieces.

The model file's pieces and scores are used as they are. Its own trainer
merged pairs, so these ids are what the library gives for the same pieces
when it searches for the best sum ("unigram"), not the ids of its merges.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, lean, slices

SPACE = "▁"
NORMAL, USER = 1, 4
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")


@dataclass
class Pieces:
    """trie: by character, (score or None, id or -1, the trie below)."""

    trie: dict[str, tuple]
    by_id: list[bytes]
    bytes_at: list[int]
    longest: int
    unknown: float
    splits_words: bool


def load(path: str) -> Pieces:
    """Pieces of a SentencePiece model file, read with the library."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    scores: dict[str, tuple[float, int]] = {}
    by_id, bytes_at = [], [-1] * 256
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            bytes_at[value] = i
            by_id.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            by_id.append(b"")
        else:
            scores[piece] = (sp.get_score(i), i)
            by_id.append(piece.replace(SPACE, " ").encode())
    trie: dict[str, tuple] = {}
    for piece in sorted(scores):  # what begins a piece comes before it
        node = trie
        for c in piece[:-1]:
            node = node.setdefault(c, (None, -1, {}))[2]
        node[piece[-1]] = (*scores[piece], {})
    # If a space begins a piece or stands among spaces only, all paths meet before a word's spaces.
    splits = not any(SPACE in p.lstrip(SPACE) for p in scores)
    return Pieces(trie, by_id, bytes_at, max(map(len, scores)), min(s for s, _ in scores.values()) - UNKNOWN_PENALTY, splits)


class StreamingViterbi:
    """feed() takes text piecemeal and gives the ids that are sure; finish() the rest.

    States are boundaries between characters. Of a boundary are kept its best
    score, where its last piece began and that piece's id. A piece that began
    further back wins a tie. Scores are sums from the stream's beginning, so
    that what is committed when changes no tie.
    """

    def __init__(self, pieces: Pieces, check_every: int = 64):
        self.p, self.every = pieces, check_every
        self.text = ""  # what follows the committed boundary
        self.done = 0  # boundaries of it whose outgoing pieces are known
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]
        self.id: list[int] = [-1]

    def feed(self, chunk: str, final: bool = False) -> list[int]:
        self.text += chunk
        out: list[int] = []
        reach = self.p.longest
        while True:
            text = self.text
            left = len(text) - self.done
            if left <= 0 or not final and left < reach:
                break
            # Up to the next check for a boundary that all paths pass.
            stop = min(self.done + self.every, len(text) if final else len(text) - reach + 1)
            self._advance(text, stop, min(len(text), stop + reach - 1))
            if not final or stop < len(text):
                out += self._commit()
        if final:
            out += self._path(len(self.text))
        return out

    def _advance(self, text: str, stop: int, end: int) -> None:
        """Extend the paths by all pieces that begin before ``stop``; none reaches beyond ``end``."""
        best, back, ids = self.best, self.back, self.id
        more = end + 1 - len(best)
        if more > 0:
            best += [NEVER] * more
            back += [-1] * more
            ids += [-1] * more
        root, unknown = self.p.trie, self.p.unknown
        for i in range(self.done, stop):
            here, j, below = best[i], i, root
            for c in text[i:end]:
                node = below.get(c)
                if node is None:
                    break
                s, k, below = node
                j += 1
                if s is not None:
                    s += here
                    if s > best[j]:
                        best[j] = s
                        back[j] = i
                        ids[j] = k
            if here + unknown > best[i + 1]:  # no piece is worse than this
                best[i + 1], back[i + 1], ids[i + 1] = here + unknown, i, -1
        self.done = stop

    def _commit(self) -> list[int]:
        """Commit what lies before the one boundary that all surviving paths pass, if there is one."""
        live = {k for k in range(self.done, len(self.best)) if self.back[k] >= 0}
        # Walk the rearmost path ends back until one boundary is left.
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(self.back[k])
        meet = live.pop() if live else 0
        if meet <= 0:
            return []
        out = self._path(meet)
        self.text = self.text[meet:]
        self.done -= meet
        self.best = self.best[meet:]
        self.back = [b - meet for b in self.back[meet:]]
        self.id = self.id[meet:]
        self.back[0] = 0
        return out

    def _path(self, k: int) -> list[int]:
        out: list[int] = []
        back, ids = self.back, self.id
        while k > 0:
            i, j = back[k], ids[k]
            if j >= 0:
                out.append(j)
            else:
                out += [self.p.bytes_at[b] for b in reversed(self.text[i:k].encode("utf-8", "replace"))]
            k = i
        out.reverse()
        return out

    def finish(self) -> list[int]:
        return self.feed("", final=True)


#: A word with the spaces before it: no path goes over its beginning.
UNIT = re.compile(r" +[^ ]*")


class Codec:
    """Whole texts to ids and back, by the stream alone; the ids of short words that it gave are remembered, up to a bound.

    All paths meet where a word begins, so that a stream may begin there: a
    word's ids don't depend on what stands around it.
    """

    def __init__(self, pieces: Pieces, remembered: int = 400_000, chunk: int = 4096):
        self.p, self.bound, self.chunk = pieces, remembered, chunk
        self.memo: dict[str, bytes] = {}

    def stream(self, text: str) -> bytes:
        v = StreamingViterbi(self.p)
        text = text.replace(" ", SPACE)
        if len(text) <= self.chunk:
            return array("i", v.feed(text, final=True)).tobytes()
        out = array("i")
        for k in range(0, len(text), self.chunk):
            out.extend(v.feed(text[k : k + self.chunk]))
        out.extend(v.finish())
        return out.tobytes()

    def _unit(self, word: str) -> bytes:
        found = self.stream(" " + word)
        if len(word) <= 40:
            if len(self.memo) >= self.bound:
                self.memo.clear()
            self.memo[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as int32; the text gets one space before it."""
        if not text:
            return np.zeros(0, np.int32)
        if not self.p.splits_words or SPACE in text:
            return np.frombuffer(self.stream(" " + text), np.int32)
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [u[1:] for u in UNIT.findall(" " + text)]
        else:
            words = text.split(" ")
        memo = self.memo
        try:
            return np.frombuffer(b"".join([memo[w] for w in words]), np.int32)
        except KeyError:
            get, unit = memo.get, self._unit
            return np.frombuffer(b"".join([get(w) or unit(w) for w in words]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        by_id = self.p.by_id
        data = b"".join([by_id[i] for i in ids.tolist()])
        text = data.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, round_trip for every row of ``docs``.

    ``model`` is the path of a model file that every executor has. Null or
    empty texts have no ids. round_trip says that decoding the ids gives the
    text again; a text that itself holds the model's space mark doesn't come
    back with it (it becomes a space), nor do lone surrogates. Repeated rows
    each give a row; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in slices(batches, 500):  # ids take more room than their text
            texts = [t if isinstance(t, str) else "" for t in b["text"].to_pylist()]
            ids = [codec.encode(t) for t in texts]
            sizes = np.array([len(i) for i in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [
                b["doc_id"],
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                pa.array([codec.decode(i) == t for i, t in zip(ids, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, forget=False), f"doc_id {kind}, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [codec.decode(np.asarray(i, np.int32)) if i is not None else "" for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


_CODECS: dict[str, Codec] = {}
KEPT.append(_CODECS)


def _codec(model: str) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(load(model))
    return _CODECS[model]
