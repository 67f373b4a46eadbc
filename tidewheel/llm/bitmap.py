"""Bitmaps over hashes: filters of bounded size before exact joins, so that texts which can't match needn't move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import textvec
from tidewheel.llm.worker import tidy

#: Bits at most (4 MB); beyond them a bitmap lets more rows through to the exact join.
BITMAP = 1 << 25
_U = np.uint64


class Bitmap:
    """A set of 64-bit hashes as bits: may say yes to others, never no to its own."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may(self, hashes: np.ndarray) -> np.ndarray:
        at = textvec.mix(hashes.view(np.uint64)) & _U(8 * len(self.bits) - 1)
        return (self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes: DataFrame, n: int) -> Bitmap:
    """Of a long column of ``n`` values: 16 bits a value, ``BITMAP`` at most. A task sends each of its words once."""
    size = min(BITMAP, max(1 << 16, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = textvec.mix(batch.column(0).to_numpy().view(np.uint64)) & _U(size - 1)
            np.bitwise_or.at(own, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], names=["word", "bits"])

    out = np.zeros(size // 64, np.uint64)
    for r in hashes.mapInArrow(tidy(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["word"]] = np.array([r["bits"]], np.int64).view(np.uint64)[0]
    return Bitmap(out.view(np.uint8))


def through(shared, hit: bool):
    """Rows whose last column, a long, may be (or can't be) in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Bitmap = shared.value
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            yield batch.filter(pa.array(own.may(last.to_numpy(zero_copy_only=False)) == hit))

    return run
