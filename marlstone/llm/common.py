"""What the corpus operators share: scratch tables, word rules, digests."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, kept, scratch_dir, written  # noqa: F401

#: A word of the plain rule: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(col: Column | str) -> Column:
    """A-Z alone in lower case; null becomes the empty text."""
    return F.translate(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), UPPER, LOWER)


_LOWER_TABLE = {ord(a): b for a, b in zip(UPPER, LOWER)}


def lower_az(text: str) -> str:
    return text.translate(_LOWER_TABLE) if not text.isascii() else text.lower()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough to be Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


#: What operators keep in a Python worker between their tasks.
KEPT: list[dict] = []


def give_back() -> None:
    """Give freed memory back to the system: a worker that serves all stages in turn would hold each one's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], *, forget: bool = True) -> Callable[[Iterator], Iterator]:
    """``run`` without what other stages' tasks keep in its worker, and with freed memory given back when it ends."""

    def task(batches: Iterator) -> Iterator:
        if forget:
            for kept_there in KEPT:
                kept_there.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
