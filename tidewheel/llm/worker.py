"""Memory of Python workers: bounded Arrow batches, caches bounded by bytes that end with their task.

A worker process outlives its task and serves later ones of other operators, so nothing that grows with the data may
stay in it.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from tidewheel.llm import textvec
from tidewheel.runtime import ship

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch where the session doesn't say: a batch of long texts is copied on both sides of the pipe.
BATCH_BYTES = "2m"
#: Bytes that an entry of a cache takes besides its key and values.
ENTRY = 150


def ready(spark: SparkSession) -> None:
    """Ship the package, and bound the bytes of a batch unless the session has a bound of its own."""
    ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)


def release() -> None:
    """Drop large power tables and give freed memory back to the system."""
    textvec._powers.shrink()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that releases memory when it ends."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


class Cache:
    """Values by word in two generations of at most ``limit`` bytes; what is met again moves on, the rest goes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.size = 0
        self.known: dict = {}
        self.older: dict = {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """The words without a value yet; the others are in ``known`` from now on."""
        if self.size > self.limit:
            self.known, self.older, self.size = {}, self.known, 0
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                    self.size += ENTRY + len(w)
                else:
                    new.append(w)
        return new

    def put(self, word: str, value, size: int = 0) -> None:
        self.known[word] = value
        self.size += ENTRY + len(word) + size
