"""Token ids in compressed files, and back.

A dataset is a folder of segments, in ascending order of doc_id. A segment is
a byte string: a header, the documents' ids and numbers of token ids, the bit
offsets of all blocks (checkpoints) and the Huffman bits. The code's lengths,
from counts over the whole corpus, stand in the folder's code table. Segments
are rows of Parquet files, so that any store that Spark reaches will do.

Layout of a segment, little-endian: magic "MTK1", u32 block size, u32 number
of documents n, u32 checksum of the code lengths; n * (u8 known, i64 doc_id);
n * u64 numbers of ids; n * u64 first byte of the document's bits; u64 number
of checkpoints c, c * u32 bit offsets counted from the document's first byte;
the bits, big-endian words of 32, each document beginning a word.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, kept, scratch_dir, written
from .huffman import BLOCK, LIMIT, Code, code_lengths

MAGIC = b"MTK1"


class WordIds:
    """Ids of whole texts by a byte-level tokenizer, with a bounded memory of words.

    Such a tokenizer cuts a text into words that take one space before them,
    so a single space between other characters is where a text can be cut. A
    text with a space at its ends or beside other white space, or with the
    string of a special token, goes to the library whole.
    """

    def __init__(self, path: str, end_id: int, remembered: int = 1_300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        #: Ids take two bytes where the vocabulary allows it.
        self.wide = max(self.tk.get_vocab_size(), end_id + 1) > 1 << 16
        self.sign, self.kind = ("I", np.uint32) if self.wide else ("H", np.uint16)
        self.end = np.array([end_id], self.kind).tobytes()
        #: None stands for a word whose text can't be cut.
        self.memo: dict[str, bytes | None] = {"": None}
        self.bound = remembered
        sizes = np.zeros(self.tk.get_vocab_size(), np.int64)
        for piece, i in self.tk.get_vocab().items():
            sizes[i] = len(piece)  # a byte-level piece has a character for each byte
        self.sizes = sizes
        #: Words encoded in a call, and in one text of it: longer texts take longer a word.
        self.step, self.line = 2000, 100
        #: What words often end with, and the ids of that.
        self.marks = dict(zip(".,!?;:", self.whole(list(".,!?;:"))))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.sign, e.ids).tobytes() for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words, each with the space before it.

        Such a tokenizer parts a letter or digit from a mark after it: a word
        that ends so has the ids of what is before the mark, and the mark's.
        """
        memo, marks = self.memo, self.marks
        every = " ".join(words)
        special = [s for s in self.special if s in every]
        sure, ended = [], []
        for w in words:
            last = w[-1]
            if w[0].isspace() or last.isspace() or w[0] == "\0" or special and any(s in w for s in special):
                memo[w] = None
            elif last in marks and "\u0250" > w[-2:-1] and w[-2:-1].isalnum():
                ended.append(w)
            else:
                sure.append(w)
        sure += {w[:-1] for w in ended}.difference(memo, sure)
        step, line = self.step, self.line
        for i in range(0, len(sure), step):  # words in a row are cut again by their lengths in bytes
            part = sure[i : i + step]
            lines = [" " + " ".join(part[k : k + line]) for k in range(0, len(part), line)]
            held = array(self.sign)
            for e in self.tk.encode_batch_fast(lines, add_special_tokens=False):
                held.extend(e.ids)
            text = np.frombuffer("".join(lines).encode(), np.uint8)
            ids = np.frombuffer(held, self.kind)
            # Each word begins with the one space that it has.
            upto = np.append(np.flatnonzero(text == 32)[1:], len(text))
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), upto) + 1
            data, at = held.tobytes(), 0
            for w, end in zip(part, (ids.itemsize * ends).tolist()):
                memo[w] = data[at:end]
                at = end
        for w in ended:
            memo[w] = memo[w[:-1]] + marks[w[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of two or four bytes, with the end id."""
        cut = [t.split(" ") for t in texts]
        if len(self.memo) > self.bound:  # the words that came first are the frequent ones
            self.memo = dict(islice(self.memo.items(), self.bound // 2))
        memo = self.memo
        self.learn(list(set().union(*cut).difference(memo)))
        # A text's first word has no space before it.
        firsts = self.whole([words[0] for words in cut])
        get = memo.__getitem__
        out: list[bytes] = []
        plain: list[int] = []
        for k, words in enumerate(cut):
            first = words[0]
            uncut = len(words) > 1 and (not first or first[-1].isspace()) or self.special and any(s in texts[k] for s in self.special)
            del words[0]
            try:
                out.append(b"" if uncut else firsts[k] + b"".join(map(get, words)) + self.end)
            except TypeError:  # a word whose text can't be cut
                uncut = True
                out.append(b"")
            if uncut:
                plain.append(k)
        for k, found in zip(plain, self.whole([texts[k] for k in plain]) if plain else ()):
            out[k] = found + self.end
        return out


_TOKENIZERS: dict[tuple[str, int], WordIds] = {}


def _tokenizer(path: str, end_id: int) -> WordIds:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordIds(path, end_id)
    return _TOKENIZERS[path, end_id]


def _parts(texts: list[str], chars: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters together, and one text at least: words of more texts are learnt at once."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of documents (doc_id, n, ids) and, one for each task, rows of counts (seen, times)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tk = _tokenizer(tokenizer, end_id)
        counts = np.zeros(1 << 16, np.int64)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for k, end in _parts(texts):
                ids = tk.ids(texts[k:end])
                found = np.bincount(np.frombuffer(b"".join(ids), tk.kind))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[: len(found)] += found
                size = 4 if tk.wide else 2
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[k:end].astype("Int64"), "n": [len(i) // size for i in ids], "sign": [zlib.crc32(i) for i in ids], "wide": tk.wide, "ids": ids, "seen": None, "times": None})
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": [0], "sign": [0], "wide": [None], "ids": [None], "seen": [seen], "times": [counts[seen]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, sign long, wide boolean, ids binary, seen array<long>, times array<long>")


def pack(docs: list[tuple[int | None, int, bytes, bytes]], check: int) -> bytes:
    """A segment from (doc_id, number of ids, bits, checkpoints)."""
    n = len(docs)
    at = np.cumsum([0] + [len(d[2]) for d in docs])[:-1]
    marks = b"".join(d[3] for d in docs)
    return b"".join(
        [
            MAGIC,
            struct.pack("<III", BLOCK, n, check),
            np.array([d[0] is not None for d in docs], np.uint8).tobytes(),
            np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
            np.array([d[1] for d in docs], "<u8").tobytes(),
            at.astype("<u8").tobytes(),
            struct.pack("<Q", len(marks) // 4),
            marks,
            *(d[2] for d in docs),
        ]
    )


def unpack(data: bytes, code: Code, check: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a segment's documents."""
    block, n, found = struct.unpack_from("<III", data, 4)
    if data[:4] != MAGIC or found != check:
        raise ValueError("not a segment of this code")
    p = 16
    known = np.frombuffer(data, np.uint8, n, p)
    p += n
    doc, sizes, at = (np.frombuffer(data, f"<{k}8", n, p + 8 * n * j) for j, k in enumerate("iuu"))
    p += 24 * n
    (c,) = struct.unpack_from("<Q", data, p)
    marks = np.frombuffer(data, "<u4", c, p + 8)
    sizes = sizes.astype(np.int64)
    blocks = -(-sizes // block)
    of = np.repeat(np.arange(n), blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    counts = np.minimum(block, sizes[of] - nth * block)
    ids = code.decode(data[p + 8 + 4 * c :], marks.astype(np.int64) + at[of].astype(np.int64) * 8, counts)
    end = np.cumsum(sizes)
    for k in range(n):
        yield (int(doc[k]) if known[k] else None), ids[end[k] - sizes[k] : end[k]]


def _segments(shared, check: int, tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code: Code = shared.value
        part, base, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            # All documents of a segment are coded side by side.
            sizes = np.array([h[1] for h in held], np.int64)
            bits, marks = code.encode_many(np.concatenate([h[2] for h in held]), sizes)
            docs = [(h[0], h[1], b, m) for h, b, m in zip(held, bits, marks)]
            return pd.DataFrame({"part": [part], "base": [base], "n_docs": [len(held)], "n_tokens": [size], "data": [pack(docs, check)]})

        for b in batches:
            for d, n, wide, ids in zip(b["doc_id"].astype("Int64"), b["n"], b["wide"], b["ids"]):
                held.append((None if d is pd.NA else int(d), int(n), np.frombuffer(ids, np.uint32 if wide else np.uint16)))
                size += int(n)
                if size >= tokens:
                    yield out()
                    base += size
                    held, size = [], 0
        if held:
            yield out()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, segment_tokens: int = 1 << 18) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) under ``path``.

    Null or empty texts have the end id alone. Documents stand in ascending
    order of doc_id, nulls first; rows that repeat one are ordered by what
    they hold. An empty table gives a dataset without segments. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    coded, scratch = written(tokenize(docs, tokenizer, end_id))
    # One row for each id that occurs: bounded by the vocabulary.
    pairs = coded.where("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "times")).alias("p")).groupBy("p.seen").agg(F.sum("p.times").alias("n")).collect()
    counts = np.zeros(max([r["seen"] for r in pairs], default=0) + 1, np.int64)
    for r in pairs:
        counts[r["seen"]] = r["n"]
    lengths = code_lengths(counts, max(LIMIT, int(len(pairs)).bit_length()))
    code, check = Code(lengths), zlib.crc32(lengths.tobytes())
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are drawn from columns without the ids, so that drawing them reads little and codes nothing. Equal ids of
    # documents would all go to one range: what else tells a row parts them.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("sign")]
    ordered = coded.where("n > 0").select("doc_id", "n", "sign", "wide", "ids").repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "ids")
    shared = spark.sparkContext.broadcast(code)  # bounded by the vocabulary
    ordered.mapInPandas(_segments(shared, check, segment_tokens), "part int, base long, n_docs long, n_tokens long, data binary").write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    drop(spark, scratch)


def _opened(spark: SparkSession, path: str) -> tuple[Code, int]:
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    return Code(lengths), zlib.crc32(lengths.tobytes())


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, decoded from the files under ``path``."""
    segments = spark.read.schema("part int, base long, n_docs long, n_tokens long, data binary").parquet(f"{path}/segments")
    code, check = _opened(spark, path)
    shared = spark.sparkContext.broadcast(code)  # bounded by the vocabulary
    # One number for each part file.
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part] = total
        total += n
    firsts = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, base, data in zip(b["part"], b["base"], b["data"]):
                at, rows = firsts.value[part] + base, []
                for doc, ids in unpack(data, shared.value, check):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    at += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})
                yield out if with_ids else out.drop(columns=["ids"])

    return segments.select("part", "base", "data").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new folder in the shared scratch space and read the files back."""
    path = scratch_dir(docs.sparkSession)
    kept(docs.sparkSession, path)
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, with_ids=False)
