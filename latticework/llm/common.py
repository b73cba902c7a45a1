"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.storage import BROADCAST_ROWS, cut, shared_dir, small

__all__ = ["BROADCAST_ROWS", "UPPER", "WORD", "ascii_lower", "cut", "fresh", "lean", "light", "narrow", "shared_dir", "small", "table", "trim"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to a Python worker, and of a side that is broadcast, as held in memory.
BATCH_BYTES, BROADCAST_BYTES = 4 << 20, 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column | str) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def narrow(spark: SparkSession) -> None:
    """Let the session send Arrow batches of at most BATCH_BYTES, so that long texts don't fill the workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, str(64 << 20)).lower().rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def light(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` of ``row_bytes`` in memory are within BROADCAST_BYTES."""
    return small(df, rows, BROADCAST_BYTES // row_bytes)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that gives its free memory back after more than a batch, as workers outlive their tasks."""

    def each(batches: Iterator) -> Iterator:
        seen = 0

        def counted() -> Iterator:
            nonlocal seen
            for batch in batches:
                seen += getattr(batch, "nbytes", BATCH_BYTES)
                yield batch

        yield from run(counted())
        if seen >= BATCH_BYTES:
            trim()

    return each


def trim() -> None:
    """Give this process's free memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
